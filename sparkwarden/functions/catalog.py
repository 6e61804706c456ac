"""Rule catalogues as data. Everything below that matches or names something is a fixed value that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A regex rule: any of the patterns finds it; `unless` (in the same block) takes the find back."""

    rule_id: str
    type: str
    name: str
    severity: str
    cwe: str
    message: str
    patterns: tuple[str, ...] = ()
    unless: str | None = None
    comments: bool = False  # whether comment lines are looked at


# fixed values: call names by category
SINKS = {
    "dangerous": "eval exec compile execfile input os.system subprocess.Popen subprocess.call".split(),
    "deserialization": """pickle.loads pickle.load pickle.Unpickler cPickle.loads cPickle.load marshal.loads marshal.load shelve.open yaml.load
        yaml.unsafe_load jsonpickle.decode dill.loads dill.load cloudpickle.loads cloudpickle.load loads load""".split(),
    "ssrf": """requests.get requests.post requests.put requests.delete requests.patch requests.head requests.options requests.request
        urllib.request.urlopen urllib.request.Request urllib.request.urlretrieve httpx.get httpx.post httpx.put httpx.delete httpx.request
        httpx.AsyncClient.get httpx.AsyncClient.post httpx.Client.get httpx.Client.post aiohttp.ClientSession.get aiohttp.ClientSession.post
        session.get session.post session.put session.delete session.request client.get client.post urlopen""".split(),
    "path_traversal": """open shutil.copy shutil.copy2 shutil.move shutil.rmtree shutil.make_archive shutil.unpack_archive os.remove os.unlink
        os.rename os.makedirs os.listdir os.mkdir os.symlink os.link os.chdir os.walk""".split(),
    "xxe": """xml.etree.ElementTree.parse xml.etree.ElementTree.fromstring xml.sax.parse xml.sax.parseString xml.dom.minidom.parse
        xml.dom.minidom.parseString xml.dom.pulldom.parse lxml.etree.parse lxml.etree.fromstring ET.parse ET.fromstring ET.iterparse
        etree.parse etree.fromstring minidom.parse minidom.parseString""".split(),
    "weak_crypto": """hashlib.md5 hashlib.sha1 Crypto.Cipher.DES.new Crypto.Cipher.ARC4.new Cryptodome.Cipher.DES.new
        Cryptodome.Cipher.ARC4.new md5 sha1""".split(),
    "template_injection": """jinja2.Environment.from_string jinja2.Template mako.template.Template mako.lookup.TemplateLookup
        django.template.Template flask.render_template_string Template render_template_string""".split(),
    "open_redirect": "flask.redirect redirect django.shortcuts.redirect HttpResponseRedirect werkzeug.utils.redirect".split(),
    "ldap_injection": "ldap.search_s ldap.search ldap.search_ext_s ldap3.Connection.search conn.search_s conn.search conn.search_ext_s connection.search".split(),
}
QUERY_SINKS = "cursor.execute execute os.popen os.popen2 os.popen3 os.popen4".split()
TAINT_SOURCES = "input os.environ sys.argv request.args request.form request.get_json open read recv".split()
TAINT_SINKS = sorted({*QUERY_SINKS, *(n for k, v in SINKS.items() if k not in ("weak_crypto", "open_redirect") for n in v)})
FLOW_SINKS = sorted({*SINKS["dangerous"], *QUERY_SINKS})
SENSITIVE_KEYWORDS = "password passwd token secret key ssn credit_card api_key auth session cookie private credential".split()
VALIDATION_MODULES = "re json html bleach".split()
VALIDATION_FUNCTIONS = "escape loads dumps clean fullmatch match search sub subn".split()
JS_VALIDATION = "encodeURIComponent escape unescape validator sanitize DOMPurify decodeURIComponent".split()
JS_DANGEROUS = "eval Function setTimeout setInterval".split()

_TAINTED = r"(?:req\.|request\.|params\.|query\.|body\.)"
# fixed values: JavaScript line rules
JS_RULES = [
    Rule("VP-JS-001", "prototype_pollution", "Prototype Pollution", "high", "CWE-1321", "Potential prototype pollution: direct modification of object prototype",
         (r"(\w+)\s*\[\s*['\"]__proto__['\"]\s*\]", r"(\w+)\.__proto__\s*=", r"(\w+)\.constructor\.prototype\s*=", r"Object\.assign\s*\(\s*\w+\.prototype")),
    Rule("VP-JS-002", "redos", "Regular Expression Denial of Service", "medium", "CWE-1333", "Regular expression with nested quantifiers may backtrack catastrophically",
         (r"new\s+RegExp\s*\(\s*['\"].*?([+*])\s*\).*?\1", r"/.*?(\([^)]*[+*][^)]*\))[+*].*?/", r"/.*?([+*])\s*\)\s*[+*].*?/")),
    Rule("VP-JS-003", "open_redirect", "Open Redirect", "medium", "CWE-601", "Redirect target comes from user-controlled input",
         (rf"window\.location\s*=\s*{_TAINTED}", rf"window\.location\.href\s*=\s*{_TAINTED}", r"res\.redirect\s*\(\s*(?:req\.|request\.)", rf"location\.replace\s*\(\s*{_TAINTED}",
          r"window\.location\s*=\s*(?:document\.URL|document\.referrer|location\.hash)", r"res\.redirect\s*\(\s*(?:url|redirect_url|next|return_to|callback)")),
    Rule("VP-JS-004", "insecure_randomness", "Insecure Randomness", "medium", "CWE-330", "Math.random() is not suitable for security values",
         (r"(?i)(?:token|secret|key|password|nonce|csrf|session|salt)\s*=.*?Math\.random\s*\(\s*\)", r"Math\.random\s*\(\s*\).*?(?:toString\s*\(\s*36\s*\))")),
    Rule("VP-JS-005", "nosql_injection", "NoSQL Injection", "high", "CWE-943", "Unsanitized input in a document-store query",
         (*(rf"\.{f}\s*\(\s*\{{[^}}]*{_TAINTED}" for f in ("find", "findOne", "update", "deleteOne")), r"\$where\s*:")),
]
LISTENER = r"addEventListener\s*\(\s*['\"]message['\"]"
ORIGIN = (r"event\.origin", r"e\.origin", r"msg\.origin", r"message\.origin")
POSTMESSAGE = Rule("VP-JS-006", "insecure_postmessage", "Insecure postMessage Handler", "medium", "CWE-346", "postMessage handler without origin validation", (LISTENER,))

# fixed values: TypeScript line rules
TS_RULES = [
    Rule("VP-TS-001", "any_type_abuse", "Excessive any Type", "low", "CWE-1007", "Type any weakens type safety", (r":\s*any\b", r"<any>", r"as\s+any\b")),
    Rule("VP-TS-002", "type_assertion_bypass", "Type Assertion Bypass", "medium", "CWE-1007", "Type assertion bypasses type checks", (r"as\s+any\b", r"as\s+unknown\b", r"<any>\s*\(")),
    Rule("VP-TS-003", "non_null_assertion", "Non-null Assertion", "low", "CWE-476", "Non-null assertion may hide a null dereference", (r"\w+!\.\w+",)),
    Rule("VP-TS-004", "ts_suppression", "Type Check Suppression", "low", "CWE-1007", "Comment suppresses type checks", (r"//\s*@ts-ignore\b", r"//\s*@ts-expect-error\b"), comments=True),
]

# fixed values: Go rules over whole files; inline flags i (case), m (line anchors), s (dot is any)
GO_RULES = [
    Rule("VP-GO-001", "go_vulnerability", "SQL Injection via String Concatenation", "critical", "CWE-89", "Query built by concatenation or formatting",
         (r'(?im)(?:(?:db|tx|conn|rows?)\.\ s*(?:Query|Exec|QueryRow|Prepare)\s*\([^)]*(?:\+|fmt\.Sprintf)|(?:query|sql|stmt|q)\s*(?::=|=|\+=)\s*(?:"[^"]*"\s*\+|fmt\.Sprintf\s*\(\s*"[^"]*%[svdq]))',)),
    Rule("VP-GO-002", "go_vulnerability", "Command Injection via os/exec", "critical", "CWE-78", "exec.Command with a dynamic argument", (r'exec\.Command\s*\(\s*(?:[^")\s]|fmt\.Sprintf|"[^"]*"\s*\+)',)),
    Rule("VP-GO-003", "go_vulnerability", "Command Injection via a shell", "critical", "CWE-78", "Shell command through exec.Command", (r'exec\.Command\s*\(\s*"(?:sh|bash|cmd)"\s*,\s*"-c"',)),
    Rule("VP-GO-004", "go_vulnerability", "Path Traversal Risk", "high", "CWE-22", "filepath.Join with user-controlled input", (r"filepath\.Join\s*\([^)]*(?:r\.(?:URL|Form|Query)|c\.(?:Param|Query)|params|userInput|req\.|input)",)),
    Rule("VP-GO-005", "go_vulnerability", "Weak Cryptography - DES", "high", "CWE-327", "Weak DES cipher", (r'"crypto/des"',)),
    Rule("VP-GO-006", "go_vulnerability", "Weak Cryptography - RC4", "high", "CWE-327", "Weak RC4 cipher", (r'"crypto/rc4"',)),
    Rule("VP-GO-007", "go_vulnerability", "Weak Hash - MD5", "medium", "CWE-328", "MD5 is not suitable for security", (r"md5\.(?:New|Sum)\b",)),
    Rule("VP-GO-008", "go_vulnerability", "Weak Hash - SHA1", "medium", "CWE-328", "SHA1 is considered weak", (r"sha1\.(?:New|Sum)\b",)),
    Rule("VP-GO-009", "go_vulnerability", "Hardcoded Password", "high", "CWE-798", "Hardcoded credential or secret", (r'(?i)(?:password|passwd|secret|apiKey|api_key|token)\s*(?::=|=)\s*"[^"]{8,}"',)),
    Rule("VP-GO-010", "go_vulnerability", "Insecure TLS - Skip Verification", "high", "CWE-295", "Certificate verification disabled", (r"InsecureSkipVerify\s*:\s*true",)),
    Rule("VP-GO-011", "go_vulnerability", "Insecure TLS - Minimum Version", "medium", "CWE-326", "Insecure minimum TLS version", (r"MinVersion\s*:\s*tls\.Version(?:SSL30|TLS10|TLS11)\b",)),
    Rule("VP-GO-012", "go_vulnerability", "Potential Race Condition", "medium", "CWE-362", "Goroutine modifies shared state", (r"(?s)go\s+func\s*\([^)]*\)\s*\{[^}]*(?:map\[|(?:=\s*append|[a-z]+\s*(?:\+\+|--|\+=|-=)))",)),
    Rule("VP-GO-013", "go_vulnerability", "Unsafe Pointer Usage", "medium", "CWE-787", "Import of package unsafe", (r'"unsafe"',)),
    Rule("VP-GO-014", "go_vulnerability", "Ignored Error Return", "low", "CWE-391", "Error return value ignored", (r"(?m)^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*,\s*_\s*(?::=|=)\s*(?:os|io|ioutil|http|sql|net|bufio|json|xml|csv)\.",)),
    Rule("VP-GO-015", "go_vulnerability", "HTTP Client Without Timeout", "medium", "CWE-400", "Default HTTP client without timeout", (r"http\.(?:Get|Post|Head|PostForm)\s*\(",)),
]
SECRET_RULE = GO_RULES[8]

# fixed values: infrastructure rules
TF_BLOCK_RULES = [
    Rule("VP-TF-001", "iac_misconfiguration", "S3 Bucket Without Encryption", "high", "CWE-311", "Bucket without server-side encryption", (r'(?i)resource\s+"aws_s3_bucket"\s+"[^"]*"',), r"(?i)server_side_encryption_configuration|aws_s3_bucket_server_side_encryption"),
    Rule("VP-TF-004", "iac_misconfiguration", "Unencrypted RDS Instance", "high", "CWE-311", "Database instance without storage encryption", (r'(?i)resource\s+"aws_db_instance"\s+"[^"]*"',), r"(?i)storage_encrypted\s*=\s*true"),
]
TF_LINE_RULES = [
    Rule("VP-TF-002", "iac_misconfiguration", "Overly Permissive Security Group", "high", "CWE-284", "Traffic allowed from every IPv4 address", (r'cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"\s*\]',)),
    Rule("VP-TF-003", "iac_misconfiguration", "IAM Wildcard Permissions", "critical", "CWE-250", "Policy grants wildcard permissions", (r'"Action"\s*:\s*"\*"|actions\s*=\s*\[\s*"\*"\s*\]',)),
    Rule("VP-TF-005", "iac_misconfiguration", "Overly Permissive IPv6 Security Group", "high", "CWE-284", "Traffic allowed from every IPv6 address", (r'ipv6_cidr_blocks\s*=\s*\[\s*"::/0"\s*\]',)),
]
DOCKER_RULES = [
    Rule("VP-DF-002", "iac_misconfiguration", "Latest Tag Used", "medium", "CWE-829", "Image with the latest tag", (r"(?i)^FROM\s+\S+:latest\b",)),
    Rule("VP-DF-003", "iac_misconfiguration", "FROM Without Tag", "medium", "CWE-829", "Image without a tag", (r"^FROM\s+([a-zA-Z0-9._/-]+)\s*$",)),
    Rule("VP-DF-004", "iac_misconfiguration", "Secrets in COPY/ADD", "critical", "CWE-540", "Secrets copied into the image", (r"(?i)^(?:COPY|ADD)\s+.*(?:\.env|\.pem|id_rsa|\.key|password|secret|credentials)",)),
    Rule("VP-DF-005", "iac_misconfiguration", "ADD with Remote URL", "medium", "CWE-829", "ADD with a remote address", (r"(?i)^ADD\s+https?://",)),
    Rule("VP-DF-006", "iac_misconfiguration", "Explicit Root USER", "high", "CWE-250", "USER is root", (r"(?i)^USER\s+root\s*$",)),
]
DOCKER_NO_USER = Rule("VP-DF-001", "iac_misconfiguration", "Running as Root", "high", "CWE-250", "No USER other than root")
K8S_RULES = [
    Rule("VP-K8-001", "iac_misconfiguration", "Privileged Container", "critical", "CWE-250", "Container runs privileged", (r"privileged:\s*true",)),
    Rule("VP-K8-002", "iac_misconfiguration", "Running as Root", "high", "CWE-250", "Container runs as user 0", (r"runAsUser:\s*0\b",)),
    Rule("VP-K8-003", "iac_misconfiguration", "Host Network Enabled", "high", "CWE-284", "Pod uses the host's network", (r"hostNetwork:\s*true",)),
    Rule("VP-K8-004", "iac_misconfiguration", "Host PID Enabled", "high", "CWE-284", "Pod sees the host's processes", (r"hostPID:\s*true",)),
    Rule("VP-K8-006", "iac_misconfiguration", "Allow Privilege Escalation", "high", "CWE-250", "Container may escalate privileges", (r"allowPrivilegeEscalation:\s*true",)),
]
K8S_NO_LIMITS = Rule("VP-K8-005", "iac_misconfiguration", "Missing Resource Limits", "medium", "CWE-770", "Container without resource limits")

SEVERITIES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCES = {"low": 1, "medium": 2, "high": 3}
# fixed values: severity registry, rule -> (severity, confidence, description)
REGISTRY = {
    "PY-EVAL-001": (4, 3, "Use of eval() with potentially untrusted input"),
    "PY-EXEC-001": (4, 3, "Use of exec() with potentially untrusted input"),
    "PY-DESER-001": (4, 3, "Deserialization of untrusted data (pickle/marshal/yaml)"),
    "PY-DESER-002": (4, 3, "Deserialization via dill/cloudpickle"),
    "PY-SQLI-001": (4, 3, "Potential SQL injection via string formatting"),
    "PY-CMDI-001": (4, 3, "Command injection via subprocess with shell=True or user input"),
    "PY-LDAP-001": (3, 3, "LDAP injection via unsanitized filter input"),
    "PY-TMPL-001": (3, 3, "Server-side template injection"),
    "PY-SSRF-001": (3, 2, "Server-side request forgery via user-controlled URL"),
    "PY-REDIR-001": (2, 2, "Open redirect via user-controlled URL"),
    "PY-PATH-001": (3, 2, "Path traversal via user-controlled file path"),
    "PY-XXE-001": (3, 3, "XML external entity injection via unsafe parser"),
    "PY-CRYPTO-001": (2, 3, "Use of weak cryptographic hash (MD5/SHA1)"),
    "PY-CRYPTO-002": (2, 3, "Use of weak cipher (DES/ARC4)"),
    "PY-SECRET-001": (3, 3, "Hardcoded secret or credential in source code"),
    "PY-COMPLEX-001": (1, 3, "High cyclomatic complexity"),
    "PY-NESTING-001": (1, 3, "Deeply nested code"),
    "PY-DEP-001": (3, 3, "Known vulnerability in Python dependency"),
    "JS-EVAL-001": (4, 3, "Use of eval() in JavaScript"),
    "JS-EXEC-001": (4, 3, "Use of child_process.exec with user input"),
    "JS-SQLI-001": (3, 3, "Potential SQL injection in JavaScript"),
    "JS-XSS-001": (3, 3, "DOM-based XSS via innerHTML or document.write"),
    "JS-PROTO-001": (2, 2, "Potential prototype pollution"),
    "JS-DEP-001": (3, 3, "Known vulnerability in npm dependency"),
}
# fixed values: CWE -> (rule, type, severity)
CWE_RULES = {
    "CWE-89": ("VP-PY-001", "sql_injection", "critical"), "CWE-78": ("VP-PY-002", "command_injection", "critical"), "CWE-79": ("VP-PY-003", "xss", "high"),
    "CWE-502": ("VP-PY-004", "deserialization", "critical"), "CWE-918": ("VP-PY-005", "ssrf", "high"), "CWE-327": ("VP-PY-006", "weak_crypto", "medium"),
    "CWE-798": ("VP-PY-007", "hardcoded_credentials", "high"), "CWE-22": ("VP-PY-008", "path_traversal", "high"), "CWE-611": ("VP-PY-009", "xxe", "high"),
    "CWE-295": ("VP-PY-010", "insecure_tls", "high"),
}
# fixed values: SARIF rule of a finding's type, VP003 for others
SARIF_RULES = {"taint_analysis": "VP001", "interprocedural_taint": "VP002", "dangerous_function": "VP003", "hardcoded_secret": "VP004", "high_complexity": "VP005", "js_vulnerability": "VP006", "dangerous_js_function": "VP006"}
SARIF_NAMES = {"VP001": "TaintedDataFlow", "VP002": "InterproceduralTaintFlow", "VP003": "DangerousFunction", "VP004": "HardcodedSecret", "VP005": "HighComplexity", "VP006": "JavaScriptVulnerability"}
#: What each rule finds, its level and its tag.
SARIF_TEXTS = {
    "VP001": ("Untrusted data reaches a dangerous call", "error", "CWE-20"), "VP002": ("Untrusted data reaches a dangerous call through other functions", "error", "CWE-20"),
    "VP003": ("A dangerous function is called", "warning", "CWE-78"), "VP004": ("A secret is written in the source", "error", "CWE-798"),
    "VP005": ("A function has many paths", "note", "CWE-1121"), "VP006": ("A weakness in JavaScript code", "warning", "CWE-94"),
}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
# fixed values: remediation by part of a type, the first that fits
REMEDIATION = {
    "eval_usage": "Replace eval() with ast.literal_eval() or a safe parser.",
    "exec_usage": "Avoid exec(). Use a restricted execution environment if dynamic code is required.",
    "hardcoded_secret": "Move secrets to environment variables or a secrets manager.",
    "subprocess_injection": "Use a list of arguments instead of shell=True. Validate all inputs.",
    "sql_injection": "Use parameterized queries or an ORM instead of string formatting.",
    "taint_flow": "Sanitize or validate all user inputs before passing to sensitive sinks.",
    "dangerous_function": "Avoid eval(), Function(), setTimeout/setInterval with string arguments.",
    "xss": "Sanitize user input with DOMPurify or equivalent before inserting into the DOM.",
    "high_complexity": "Refactor into smaller functions. Aim for cyclomatic complexity < 10.",
}
REMEDIATION_DEFAULT = "Review the finding and apply appropriate security controls."
# fixed values: profiles -> pattern matching, taint, interprocedural, dependencies, ML scoring, JavaScript
PROFILES = {
    "quick": (True, False, False, False, False, True),
    "standard": (True, True, True, True, False, True),
    "deep": (True, True, True, True, True, True),
}
PROFILE_FLAGS = ("pattern_matching", "taint_analysis", "interprocedural_analysis", "dependency_check", "ml_scoring", "js_analysis")
# fixed values: suffixes and folders of the scanners
SCANNERS = {
    "python": ((".py",), ()),
    "javascript": ((".js",), ()),
    "js_patterns": ((".js", ".jsx", ".mjs", ".ts", ".tsx"), ("node_modules", ".git", "__pycache__", "dist", "build", ".next")),
    "typescript": ((".ts", ".tsx"), ("node_modules", ".git", "__pycache__", "dist", "build", ".next")),
    "go": ((".go",), (".git", "__pycache__", "node_modules", "vendor", "dist", "build", ".terraform", "testdata")),
    "iac": ((".tf", ".yaml", ".yml"), (".git", "__pycache__", "node_modules", ".terraform", "dist", "build", ".next", "vendor")),
}
SCANNABLE = (".py", ".js", ".jsx", ".ts", ".tsx")
