"""Elements of large JSON documents: every way of cutting a file into blocks gives the same."""

import json
import random

import pytest

from sparkwarden.sources.json_stream import read_elements


def value(r, depth=0):
    x = r.random()
    if depth > 3 or x < 0.4:
        return r.choice([1, -2.5e3, True, None, "", "plain", 'q"uote', "back\\", 'both\\"', "{[}]", "é字\n\t", "\\\\\\", "}" * 5])
    if x < 0.7:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["a", 'k"', "}", "\\"]) + str(i): value(r, depth + 1) for i in range(r.randint(0, 3))}


def read(spark, path, block, **more):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return sorted(json.dumps(json.loads(r.json), sort_keys=True) for r in read_elements(spark, str(path), **more).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed,indent", [(0, None), (1, 2), (2, None)])
def test_any_blocks(spark, tmp_path, seed, indent):
    r = random.Random(seed)
    elements = [{"cve": value(r), "n": i} for i in range(120)]
    doc = {"format": "x {", "vulnerabilities": elements, "tail": {"a": "]"}}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=seed == 0) + "\n")
    want = sorted(json.dumps(e, sort_keys=True) for e in elements)
    for block in (1 << 20, 1000, 333, 64):
        assert read(spark, path, block) == want


def test_an_element_longer_than_many_blocks(spark, tmp_path):
    elements = [{"a": 1}, {"b": "x}{\\" * 5000, "c": [{"d": "}"}] * 500}, {"e": 2}]
    (tmp_path / "doc.json").write_text(json.dumps({"v": elements}))
    assert read(spark, tmp_path / "doc.json", 500) == sorted(json.dumps(e, sort_keys=True) for e in elements)


def test_several_files_documents_and_levels(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"v": [{"k": i}]}) + "\n" for i in range(50)))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"v": [{"k": 100 + i} for i in range(50)]}))
    (tmp_path / "in" / "empty.json").write_text("")
    (tmp_path / "in" / "none.json").write_text('{"v": []}')
    want = sorted(json.dumps({"k": i}) for i in [*range(50), *range(100, 150)])
    assert read(spark, tmp_path / "in", 200) == want
    (tmp_path / "top.json").write_text(json.dumps([{"k": i} for i in range(9)]))
    assert len(read(spark, tmp_path / "top.json", 30, level=1)) == 9


def test_text_that_ends_early(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"v": [{"a": 1}, {"b": "open')
    assert read(spark, tmp_path / "cut.json", 1000)[0] == '{"a": 1}'
