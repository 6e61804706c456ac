"""A code corpus derived from the documents table: a snippet for each document, by its id, above the document's text.

It grows with the documents, holds something for every detector, and SQL can build the same, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: file name ({} is the document's id), snippet
SNIPPETS = [
    ("app/d{}.py", "def load(user):\n    data = input()\n    eval(data)\n    return data"),
    ("app/d{}.py", "def add(a, b):\n    return a + b"),
    ("lib/d{}.py", "import yaml, pickle\n\ndef read_all(path, api_key):\n    cfg = yaml.load(path, Loader=yaml.SafeLoader)\n    raw = open(path)\n    blob = pickle.loads(raw)\n    pickle.loads(blob)\n    return cfg"),
    ("lib/d{}.py", "def outer(x):\n    def inner(y):\n        os.system(y)\n    for i in x:\n        if i and x:\n            inner(i)\n    while x:\n        with x:\n            exec(x)"),
    ("app/d{}.py", "def first(conn):\n    q = request.args()\n    cursor.execute(q)\n    helper(q)\n\ndef helper(z):\n    os.popen(z)"),
    ("net/d{}.py", 'def fetch(url, token):\n    session_id = read()\n    requests.get(session_id)\n    html.escape(url)\n    re.match("a", url)'),
    ("app/d{}.py", "def broken(:\n    pass"),
    ("web/d{}.js", "function run(code) {\n  eval(code); // eval(here)\n  setTimeout(code, 10);\n  new Function(code);\n  obj.eval(code);\n}\ntarget.__proto__ = source;\ntarget['__proto__'] = 1;\n// x.__proto__ = 2"),
    ("web/d{}.js", "window.location = req.query.next;\nres.redirect(url);\nconst token = 'a' + Math.random();\nconst id = Math.random().toString(36);\nusers.find({ name: req.body.name });\nitems.find({ $where: code });"),
    ("web/d{}.js", "window.addEventListener('message', (event) => {\n  if (event.origin !== home) return;\n  use(event.data);\n});"),
    ("web/d{}.js", 'window.addEventListener("message", (m) => {\n  use(m.data);\n});\nconst a = /(x+)+y/;\nconst b = new RegExp("(a+)+");'),
    ("ui/d{}.ts", "let a: any = 1;\nlet b = <any>(c);\nlet d = e as unknown as F;\nlet g = h!.i;\n// @ts-ignore\n/* let z: any */"),
    ("srv/d{}.go", 'package main\n\nimport "crypto/des"\nimport "unsafe"\n\nfunc f(db *sql.DB) {\n\tquery := "SELECT " + name\n\texec.Command("sh", "-c", arg)\n\n\tx, _ := os.Open(p)\n\tpassword = "hunter2hunter2"\n\thttp.Get(u); http.Get(v)\n}'),
    ("srv/d{}.go", 'package main\nvar c = &tls.Config{InsecureSkipVerify: true, MinVersion: tls.VersionTLS10}\nfunc g() { md5.New(); sha1.Sum(b); filepath.Join(base, userInput); exec.Command(name) }\nfunc h() {\n\tgo func() {\n\t\tcount++\n\t}()\n}'),
    ("infra/d{}.tf", 'resource "aws_s3_bucket" "logs" {\n  bucket = "x"\n}\n\nresource "aws_s3_bucket" "safe" {\n  server_side_encryption_configuration {\n  }\n}\nresource "aws_security_group" "open" {\n  ingress {\n    cidr_blocks = ["0.0.0.0/0"]\n    ipv6_cidr_blocks = ["::/0"]\n  }\n}'),
    ("infra/d{}.tf", 'resource "aws_db_instance" "db" {\n  engine = "x"\n}\nresource "aws_db_instance" "kept" {\n  storage_encrypted = true\n}\ndata "p" "q" {\n  actions = ["*"]\n}'),
    ("img/d{}/Dockerfile", "FROM base:latest\nFROM alpine\n# USER app\nCOPY id_rsa /root/\nADD https://x.example/a /a\nUSER root"),
    ("img/d{}/Dockerfile", "from base:1.2\nRUN make\nUSER app"),
    ("k8s/d{}.yaml", "apiVersion: v1\nkind: Pod\nspec:\n  hostNetwork: true\n  hostPID: true\n  containers:\n  - securityContext:\n      privileged: true\n      runAsUser: 0\n      allowPrivilegeEscalation: true"),
    ("k8s/d{}.yaml", "apiVersion: v1\nkind: Pod\nspec:\n  containers:\n  - resources:\n      limits:\n        cpu: 1"),
    ("k8s/d{}.yaml", "privileged: true\nhostPID: true"),
    ("web/d{}.js", "a.__proto__ = b; // sparkwarden-ignore: vp-js-001, OTHER\nc.__proto__ = d; // sparkwarden-ignore-line\ne.__proto__ = f; // SPARKWARDEN-IGNORE: VP-JS-005\ng.__proto__ = h;"),
    ("sec/d{}.py", "def parse(path, password):\n    tree = ET.parse(path)\n    hashlib.md5(password)\n    jinja2.Template(path)\n    conn.search_s(path)\n    hashlib.sha1(tree)\n    return redirect(path)"),
    ("srv/d{}.go", 'package main\nimport "crypto/rc4"\nfunc k() { rows.Query("a" + b) }'),
    ("lib/d{}.py", "import sys\n\ndef last(a):\n    v = input()\n    v = recv()\n    os.popen(v, v)\n    w = open(a)\n    return w"),
]


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code(doc_id, sid, file, content); text below Python snippets is comments, so that it parses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    snippets = F.broadcast(spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(SNIPPETS)], "sid bigint, name string, snippet string"))
    both = docs.withColumn("sid", F.col("doc_id") % len(SNIPPETS)).join(snippets, "sid")
    below = F.when(F.col("name").endswith(".py"), F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))).otherwise(F.col("text"))
    return both.select("doc_id", "sid", F.replace("name", F.lit("{}"), F.col("doc_id").cast("string")).alias("file"), F.concat("snippet", F.lit("\n"), below).alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("file", "content")


def quoted(text: str) -> str:
    """text as an SQL string literal; line ends and tabs by their numbers."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


_ROWS = ", ".join(f"({i}, {quoted(n)}, {quoted(s)})" for i, (n, s) in enumerate(SNIPPETS))
#: Common table expressions for oracles: code, lines.
CODE_SQL = f"""
snippets(sid, name, snippet) AS (VALUES {_ROWS}),
code AS (SELECT doc_id, sid, replace(name, '{{}}', CAST(doc_id AS VARCHAR)) AS file,
  snippet || chr(10) || CASE WHEN name LIKE '%.py' THEN '# ' || replace(coalesce(text, ''), chr(10), chr(10) || '# ') ELSE coalesce(text, '') END AS content
  FROM documents JOIN snippets ON doc_id % {len(SNIPPETS)} = sid),
lines AS (SELECT file, unnest(string_split(content, chr(10))) AS line, CAST(unnest(generate_series(1, len(string_split(content, chr(10))))) AS BIGINT) AS line_no FROM code)
"""
