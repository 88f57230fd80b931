"""Column functions on literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from changelens.functions.code import code_extract, template_extract
from changelens.functions.jsonx import json_extract, json_path, query_shape
from changelens.functions.paths import file_ext, glob_any, glob_regex, language_of
from changelens.functions.refs import parse_pr_url, parse_use
from changelens.functions.regex import java_pattern, js_flags, regex_extract, required_literal
from changelens.functions.template import render
from changelens.functions.xmlx import map_namespaces, xml_extract


def value(spark, column, **fields):
    """The column over one row of literal fields."""
    schema = ", ".join(f"{k} string" for k in fields) or "x string"
    return spark.createDataFrame([tuple(fields.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("package.json", "package.json", True),
        ("package.json", "a/package.json", False),
        ("src/**/*.ts", "src/a.ts", True),
        ("src/**/*.ts", "src/x/y/a.ts", True),
        ("src/**/*.ts", "src/.x/a.ts", False),
        ("src/*.ts", "src/x/a.ts", False),
        ("*", ".hidden", False),
        (".*", ".hidden", True),
        ("**", "a/b/c", True),
        ("a/**", "a", False),
        ("a/**", "a/b", True),
        ("a?c", "abc", True),
        ("a?c", "a/c", False),
        ("[ab].txt", "b.txt", True),
        ("[!ab].txt", "b.txt", False),
        ("[!ab].txt", "c.txt", True),
        ("x.{js,ts}", "x.ts", True),
        ("{a,b/{c,d}}/z", "b/d/z", True),
        ("v{1..3}", "v2", True),
        ("!*.md", "a.txt", True),
        ("!*.md", "a.md", False),
        ("#x", "#x", False),
        ("\\#x", "#x", True),
        ("A.txt", "a.txt", False),
        ("a.b", "axb", False),
    ],
)
def test_glob(spark, glob, path, hit):
    assert value(spark, glob_any(F.col("p"), [glob]), p=path) is hit


def test_extended_globs_are_refused():
    with pytest.raises(ValueError, match="Extended globs"):
        glob_regex("+(a|b)")


@pytest.mark.parametrize(
    ("path", "ext"),
    [("a/b.TS", ".ts"), (".bashrc", ""), ("a.b.c", ".c"), ("x.", "."), ("dir.d/x", ""), ("a/..", ""), ("a.js/", ".js")],
)
def test_extension(spark, path, ext):
    assert value(spark, file_ext(F.col("p")), p=path) == ext


def test_language_override_and_errors(spark):
    assert value(spark, language_of(F.col("p"), ".js"), p="x.unknown") == "javascript"
    with pytest.raises(Exception, match="Unsupported language"):
        value(spark, language_of(F.col("p")), p="test.xyz")
    with pytest.raises(ValueError, match="Unsupported language"):
        language_of(F.lit("a.py"), ".xyz")


def test_regex_translation():
    rx, names = java_pattern(r"(?<a_b>x)(?:y)[(](z)(?<c>\k<a_b>)")
    assert names == {"a_b": 1, "c": 3}
    assert rx == r"(?m)(x)(?:y)[(](z)(\1)"
    assert java_pattern(r"\u{41}a{2,}b{c[[&\b]\0(?<!x)(?<=y)(?!z)", "g")[0] == r"\x{41}a{2,}b\{c[\[\&\x08]\x00(?<!x)(?<=y)(?!z)"
    assert [js_flags(f) for f in ("", "g", "gm", "i", "s")] == ["(?m)", "", "(?m)", "(?miu)", "(?ms)"]
    with pytest.raises(ValueError, match="Invalid flags"):
        js_flags("q")


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [("API_KEY=.*", "API_KEY="), ("a|b", ""), ("abc?", "ab"), ("ab*c", "a"), ("(?:abc)?d", "d"), (r"x{2,}yz\d", "yz"), ("[@]", ""),
     (r"\u0041bc", "bc"), (r"\u{1F600}", ""), (r"\p{Lu}x", "x"), (r"a\x41", "a"), (r"(a)\12b", "b"), (r"(?<n>a)\k<n>", ""), (r"a\.b\(", "a")],
)
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal
    assert required_literal(pattern, "i") == ""


ENV = "MAP_SIDE=one\nGRID_SIDE=two\nLAYER_X=false\nZOOM=5432\n"


@pytest.mark.parametrize(
    ("pattern", "flags", "text"),
    [
        ("MAP_SIDE=.*", "", "MAP_SIDE=one"),
        (".*_SIDE=.*", "", "MAP_SIDE=one\nGRID_SIDE=two"),
        ("layer_.*", "i", "LAYER_X=false"),
        ("^ZOOM=5432$", "", "ZOOM=5432"),
        ("^ZOOM", "g", ""),
        ("GRID.*ZOOM", "s", "GRID_SIDE=two\nLAYER_X=false\nZOOM"),
        ("absent", "", ""),
    ],
)
def test_regex_matches(spark, pattern, flags, text):
    assert value(spark, regex_extract(F.col("c"), pattern, flags), c=ENV)["text"] == text


def test_regex_context_and_empty_sides(spark):
    got = value(spark, regex_extract(F.col("c"), r"^(?<base_key>\w+)_SIDE=(?<v>.*)$"), c=ENV)
    assert got["context"] == ['[{"base_key":"MAP","v":"one"},{"base_key":"GRID","v":"two"}]']
    assert value(spark, regex_extract(F.col("c"), "ZOOM"), c=ENV)["context"] == ["[]"]
    for empty in (None, ""):
        got = value(spark, regex_extract(F.col("c"), ".*"), c=empty)
        assert (got["text"], got["context"]) == ("", [])


PACKAGE = '{"name":"n","version":"1.0.0","dependencies":{"b":"^2","a":"1"},"scripts":{"test:x":"t","build":"b"},"n":1.50,"e":{}}'


@pytest.mark.parametrize(
    ("query", "text"),
    [
        (".version", '"1.0.0"\n'),
        (".missing", "null\n"),
        (".dependencies | keys", '[\n  "a",\n  "b"\n]\n'),
        (".dependencies", '{\n  "b": "^2",\n  "a": "1"\n}\n'),
        (".dependencies | del(.b)", '{\n  "a": "1"\n}\n'),
        ('.scripts | to_entries | map(select(.key | startswith("test")))', '[\n  {\n    "key": "test:x",\n    "value": "t"\n  }\n]\n'),
        (".e", "{}\n"),
        ('.scripts["test:x"]', '"t"\n'),
        ('.dependencies | del(.a, ."b")', "{}\n"),
        (".e | keys", "[]\n"),
        (".dependencies.a", '"1"\n'),
    ],
)
def test_json_rules(spark, query, text):
    assert value(spark, json_extract(F.col("c"), query), c=PACKAGE)["text"] == text


def test_json_edge_cases(spark):
    assert value(spark, json_extract(F.col("c"), ".a"), c=None)["text"] == ""
    assert value(spark, json_extract(F.col("c"), ".a"), c=" \n")["text"] == ""
    assert value(spark, json_extract(F.col("c"), ".a", strict=False), c="{broken")["text"] == ""
    with pytest.raises(Exception, match="(?i)malformed"):
        value(spark, json_extract(F.col("c"), ".a"), c="{broken")
    assert value(spark, json_path(F.col("c"), "$.s"), c='{"s":"a\\"{é"}') == '"a\\"{é"'
    with pytest.raises(ValueError, match="Unsupported JSON query"):
        query_shape(".a | reduce .")


def test_a_json_value_is_read_from_its_document_once(spark):
    rows = [
        (1, '{"a": {"s": "x", "n": 1.50, "o": {"t": [1, "2"]}, "z": null, "b": "{}"}}'), (2, '{"a": "{\\"s\\": 1}"}'), (3, '{"a": {}}'),
        (4, '{"a": [ {"b": 1} ]}'), (5, '{"b": 1}'), (6, ""), (7, None), (8, " "), (9, '{"a": null}'), (9, '{"a": null}'),
    ]
    found = spark.createDataFrame(rows, "i int, c string").select("i", json_extract(F.col("c"), ".a")["text"].alias("t"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(c#") == 1
    assert [r.t for r in sorted(found.collect())] == [
        '{\n  "s": "x",\n  "n": 1.5,\n  "o": {"t":[1,"2"]},\n  "z": null,\n  "b": "{}"\n}\n', '"{\\"s\\": 1}"\n', "{}\n",
        '[{"b":1}]\n', "null\n", "", "", "", "null\n", "null\n",
    ]



POM = '<project xmlns="http://maven"><version>1.0.0</version><deps><d><version>5.3</version></d><d><version>2.1</version></d></deps></project>'


@pytest.mark.parametrize(
    ("expression", "text"),
    [
        ('string(//*[local-name()="d"][2]/*[local-name()="version"])', "2.1"),
        ("//d/version", "5.3\n2.1"),
        ("count(//d)", "2"),
        ("boolean(//d)", "true"),
        ("//absent", ""),
    ],
)
def test_xpath_rules(spark, expression, text):
    assert value(spark, xml_extract(F.col("c"), expression), c=POM)["text"] == text


@pytest.mark.parametrize(
    "broken",
    [None, "", "plain", "<a><b></a>", "<a/>x", "<a></a><a></a>", "<a></a><b></b>", "<a>&bad;</a>", "<a><a></a>", "x<a></a>"],
)
def test_malformed_xml_is_empty(spark, broken):
    assert value(spark, xml_extract(F.col("c"), "//a | //b"), c=broken)["text"] == ""


@pytest.mark.parametrize(
    "sound",
    ["<a>v</a>", "<a>v</a>\n", "<?xml version='1.0'?><a>v</a>", "<!-- <a> --><a>v</a><!-- </a> -->", "<!DOCTYPE a><a>v</a>",
     "<a>v<a/></a>", "<a>v<![CDATA[</a>]]></a>"],
)
def test_sound_xml(spark, sound):
    assert value(spark, xml_extract(F.col("c"), "string(/a/text())"), c=sound)["text"].startswith("v")


def test_namespace_steps():
    got = map_namespaces("//m:v[x='m:v']/m:w", {"m": "u"})
    assert got.count("substring-after") == 2 and "'m:v'" in got


PYTHON = "import os\n\n\n@cache\ndef one(a):\n    return a\n\n\nasync def two():\n    if x:\n        y()\n\n    return 1\n\n\nclass Box(Base):\n    def size(self):\n        return 1\n"
TYPESCRIPT = "export interface A {\n  x: number\n}\n\ntype Id = string;\n\nexport class B extends C {\n  private async run(a: X): Promise<void> {\n    if (a) {}\n  }\n}\n"
RUST = "pub trait T {\n}\n\nimpl Display for Foo {\n    fn fmt(&self) -> u8 {\n        1\n    }\n}\n\npub(crate) enum E {\n    A,\n}\n"
GO = "package p\n\nfunc (h *H) Get(x int) {\n\treturn\n}\n\nfunc New() *H {\n\treturn nil\n}\n\ntype H struct {\n\ta int\n}\n"
JAVA = "public class S {\n    public int f(int a) {\n        return g(a);\n    }\n}\n\ninterface I {\n}\n\nenum M { A, B }\n"


@pytest.mark.parametrize(
    ("path", "code", "kind", "names"),
    [
        ("a.py", PYTHON, "function", "one,two,size"),
        ("a.py", PYTHON, "class", "Box"),
        ("a.py", PYTHON, "method", "size"),
        ("a.py", PYTHON, "decorated", "one"),
        ("a.ts", TYPESCRIPT, "interface", "A"),
        ("a.ts", TYPESCRIPT, "type", "Id"),
        ("a.ts", TYPESCRIPT, "class", "B"),
        ("a.ts", TYPESCRIPT, "method", "run"),
        ("a.rs", RUST, "trait", "T"),
        ("a.rs", RUST, "impl", "Foo"),
        ("a.rs", RUST, "enum", "E"),
        ("a.rs", RUST, "function", "fmt"),
        ("a.go", GO, "method", "Get"),
        ("a.go", GO, "function", "New"),
        ("a.go", GO, "struct", "H"),
        ("A.java", JAVA, "class", "S"),
        ("A.java", JAVA, "method", "f"),
        ("A.java", JAVA, "interface", "I"),
        ("A.java", JAVA, "enum", "M"),
    ],
)
def test_declaration_names(spark, path, code, kind, names):
    got = value(spark, code_extract(F.col("c"), F.col("p"), kind, "name"), c=code, p=path)
    assert got["text"].split("\n\n") == names.split(",")


def test_declaration_bodies(spark):
    got = value(spark, code_extract(F.col("c"), F.col("p"), "function"), c=PYTHON, p="a.py")
    assert got["text"] == (
        "def one(a):\n    return a\n\nasync def two():\n    if x:\n        y()\n\n    return 1\n\ndef size(self):\n        return 1"
    )
    assert got["context"] == ['[{"name":"one"},{"name":"two"},{"name":"size"}]']
    got = value(spark, code_extract(F.col("c"), F.col("p"), "enum"), c=JAVA, p="a.java")
    assert got["text"] == "enum M { A, B }"


def test_long_declarations_do_not_overflow(spark):
    body = "".join(f"  if (a{i}) {{ b({i}) }}\n" for i in range(20_000))
    code = f"function big() {{\n{body}}}\n"
    got = value(spark, code_extract(F.col("c"), F.col("p"), "function"), c=code, p="a.js")
    assert got["text"] == code.rstrip("\n")
    got = value(spark, template_extract(F.col("c"), "function $NAME() { $$$BODY }"), c=code)
    assert got["text"] == code.rstrip("\n")


@pytest.mark.parametrize(
    ("code", "template", "text", "context"),
    [
        ("function a(x, y) { return {b: 1} }\n", "function $NAME($$$P) { $$$B }", "function a(x, y) { return {b: 1} }",
         [{"NAME": "a", "P": "x, y", "B": "return {b: 1} "}]),
        ("fetch(url(1), 2); fetch()", "fetch($$$ARGS)", "fetch(url(1), 2)\n\nfetch()", [{"ARGS": "url(1), 2"}]),
        ("class A(Enum):\nclass B(C):", "class $NAME(Enum)", "class A(Enum)", [{"NAME": "A"}]),
        ("type X = Y\n", "type $NAME = $TYPE", "type X = Y", [{"NAME": "X", "TYPE": "Y"}]),
        ("#[derive(Debug, Clone)]", "#[derive($$$D)]", "#[derive(Debug, Clone)]", [{"D": "Debug, Clone"}]),
        ("a == a; a == b", "$X == $X", "a == a", [{"X": "a"}]),
        ("#[test]\nfn x() {}", "#[test]", "#[test]", []),
    ],
)
def test_templates(spark, code, template, text, context):
    import json

    got = value(spark, template_extract(F.col("c"), template), c=code)
    assert got["text"] == text
    assert json.loads(got["context"][0]) == context


def test_template_selector(spark):
    got = value(spark, template_extract(F.col("c"), "static args = $ARGS", "ARGS"), c="class C { static args = X }")
    assert got["text"] == "X"
    with pytest.raises(ValueError, match="Selector"):
        template_extract(F.lit(""), "a $B", "C")


def test_render(spark):
    values = {"filePath": F.col("p"), "diffText": F.col("d")}
    got = value(spark, render("{{filePath}} {{{filePath}}} {{ diffText }}{{x.y}}", values), p="a<b", d="{{filePath}} & <")
    assert got == "a&lt;b a<b {{filePath}} & <"
    with pytest.raises(ValueError, match="plain names"):
        render("{{#if x}}", values)


def test_references(spark):
    got = value(spark, parse_use(F.col("u")), u="#defined/watches/a/b")
    assert (got["kind"], got["name"]) == ("watches", "a/b")
    assert value(spark, parse_use(F.col("u")), u=None) is None
    with pytest.raises(Exception, match="Invalid reference format"):
        value(spark, parse_use(F.col("u")), u="#defined/other/x")
    with pytest.raises(Exception, match="Invalid pull request URL"):
        value(spark, parse_pr_url(F.col("u"), strict=True), u="https://github.com/a/b")
    assert re.fullmatch(r"\d+", str(value(spark, parse_pr_url(F.col("u")), u="https://github.com/a/b/pull/12")["number"]))


def test_line_starts_are_asked_behind_plain_text(spark):
    assert java_pattern("^The [a-z]+")[0].startswith("(?m)The (?<=")
    assert java_pattern("^The", "g")[0] == r"\AThe" and java_pattern("^b*c")[0].startswith("(?m)(?<!")
    start = "(?<![^\n\r\u2028\u2029])"
    texts = ["ab ab\nab\rabb\r\nab\u2028ab\u0085ab\n", "AB\nxab\n\nab", "b\nab\u2028ab", "", "\nab\n", "a\naab\u2029aB"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in ("^ab", "^ab*", "^ab+b", "(?:^a|^b)b?", "^a{1}b", "x|^ab", "^aab?", "^a^b|^ab$", "[^x]^ab"):
        for flags in ("", "i", "gm"):
            found = {r.i: r.text for r in rows.select("i", regex_extract(F.col("t"), pattern, flags)["text"].alias("text")).collect()}
            plain = pattern.replace("[^x]", "[!x]").replace("^", start).replace("[!x]", "[^x]").replace("$", "(?![^\n\r\u2028\u2029])")
            assert found == {i: "\n".join(re.findall(plain, t, re.I if "i" in flags else 0)) for i, t in enumerate(texts)}, (pattern, flags)
