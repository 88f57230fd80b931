"""Code declarations and templates on plain texts."""

import time

import pytest
import regex
from pyspark.sql import functions as F

from changelens.functions.code import find_declarations, find_templates, shadow, template_regex

RUST = """
pub struct Pair(u8, u8);

pub struct Store<'a> {
    left: &'a str,
}

impl<'a> Store<'a> {
    pub fn open(path: &'a str) -> Self {
        fn inner() -> char { '}' }
        Store { left: path }
    }

    pub(crate) async fn close(self) {
        if true { match 1 { _ => { loop { break } } } }
    }
}

trait Shape {
    fn area(&self) -> f64;
    fn name(&self) -> String { String::from("{") }
}

#[cfg(test)]
mod tests {
    #[test]
    fn it_opens() { /* { */ assert!(true); }
}
"""


def names(code, language, kind):
    return [d["name"] for d in find_declarations(code, language, kind)]


def test_nested_functions_of_all_depths():
    found = find_declarations(RUST, "rust", "function")
    assert [d["name"] for d in found] == ["open", "inner", "close", "area", "name", "it_opens"]
    assert found[0]["body"].startswith("pub fn open") and found[0]["body"].endswith("Store { left: path }\n    }")
    assert found[1]["body"] == "fn inner() -> char { '}' }"
    assert found[3]["body"] == "fn area(&self) -> f64;"
    assert names(RUST, "rust", "struct") == ["Pair", "Store"] and names(RUST, "rust", "impl") == ["Store"]


def test_type_expressions():
    code = 'type A = {\n  b: { c: string }\n}\ntype B =\n  | "x"\n  | "y"\nexport type C<T> = T extends string ? 1 : 2;\nlet d = 1\n'
    bodies = [d["body"] for d in find_declarations(code, "typescript", "type")]
    assert bodies == ["type A = {\n  b: { c: string }\n}", 'type B =\n  | "x"\n  | "y"', "export type C<T> = T extends string ? 1 : 2;"]


def test_calls_and_prototypes_are_no_declarations():
    assert names("  foo(a)\n  if (b) { c() }\n", "javascript", "method") == []
    assert names("int f(int);\nint g(int a) { return f(a); }\n", "c", "function") == ["g"]
    assert names("// function no() {}\n/*\nfunction no2() {}\n*/\nfunction yes() {}", "javascript", "function") == ["yes"]


def test_python_blocks_end_at_the_indentation():
    code = 'class A:\n    """\nclass in a text\n"""\n    def f(self,\n          b=[1,\n2]):\n        x = """\nnot the end"""\n        return x  # done\n\n# between\n    y = 1\nz = 2\n'
    found = find_declarations(code, "python", "function")
    assert [d["body"] for d in found] == ['def f(self,\n          b=[1,\n2]):\n        x = """\nnot the end"""\n        return x  # done']
    assert find_declarations(code, "python", "class")[0]["body"].endswith("    y = 1")
    assert names(code, "python", "class") == ["A"]


@pytest.mark.parametrize("language", ["javascript", "python", "rust", "go", "c"])
def test_what_is_not_closed_runs_to_the_end(language):
    header = {"javascript": "function f() {", "python": "def f():", "rust": "fn f() {", "go": "func f() {", "c": "int f() {"}[language]
    assert find_declarations(f"{header}\n  (((", language, "function")[0]["body"].endswith("(((")


def matches(template, code, selector=None):
    rx, holes = template_regex(template)
    return find_templates(code, rx, holes, selector)


@pytest.mark.parametrize("depth", [1, 4, 5, 30, 200])
def test_brackets_nest_to_any_depth(depth):
    call = "f(" + "g(" * depth + "1" + ")" * depth + ")"
    assert matches("f($$$A)", f"x {call} y")["shown"] == [call]


@pytest.mark.parametrize(
    ("template", "code", "holes"),
    [
        ("type $NAME = $TYPE", 'type Mood = "good" | "bad"\n', {"NAME": "Mood", "TYPE": '"good" | "bad"'}),
        ("const $A = $B;", "const x = await load(a, [1, 2]).then((y) => y);", {"A": "x", "B": "await load(a, [1, 2]).then((y) => y)"}),
        ("log($X)", "log(a + b[0])", {"X": "a + b[0]"}),
        ("$A == $A", "x.y == x.y", {"A": "x.y"}),
        ("type $N = $T", "type A = Map<string, Map<string, Set<number>>>\nx", {"N": "A", "T": "Map<string, Map<string, Set<number>>>"}),
        ("type $N = $T", "type A = Promise<(a: number) => void>;", {"N": "A", "T": "Promise<(a: number) => void>"}),
        ("type $N = $T", "type A = Map<\n  string,\n  Set<[a, b]>\n>\ny = 2", {"N": "A", "T": "Map<\n  string,\n  Set<[a, b]>\n>"}),
        ("f($$$A, $LAST)", "f(\n  g(a, b),\n  [1, 2],\n  c\n)", None),
        ("f($A)", "f(new Set<string>(x<y))", {"A": "new Set<string>(x<y)"}),
        ("if ($A) { $$$ }", "if (a<b) { x } c>d", {"A": "a<b"}),
        ("$A<$B>", "x: List<int>", {"A": "List", "B": "int"}),
        ("f($X", "g(f(a", {"X": "a"}),
        ("func $NAME($$$P) { $$$B }", "func run(a map[int]string) { x() }", {"NAME": "run", "P": "a map[int]string", "B": "x() "}),
    ],
)
def test_holes(template, code, holes):
    if holes is None:
        holes = {"A": "g(a, b),\n  [1, 2]", "LAST": "c"}
    assert matches(template, code)["holes"] == [holes]


def test_one_expression_is_not_two():
    assert matches("log($X)", "log(a, b)")["shown"] == []
    assert matches("impl $T { $$$B }", "impl A for B { }")["shown"] == []


def test_shadow_keeps_places():
    text = "a\ufdd0(b<c>(\"(\" d) [ e<f"
    assert shadow(text) == "a\ufdd3\ufdd2b\ufdd0c\ufdd1(\"(\" d) \ufdd2 e<f" and len(shadow(text)) == len(text)


def test_only_parts_that_hold_themselves_are_called():
    # A call stores the state of the whole pattern, also where nothing is nested.
    rx, _ = template_regex("const $NAME = $VALUE;")
    assert set(regex.compile(rx).groupindex) == {"quoted", "inside", "h1", "h2"}


@pytest.mark.parametrize(
    ("template", "code", "holes"),
    [
        ("$A = $B;", "x = !a.b!(c) + -d[0] ?? e;", {"A": "x", "B": "!a.b!(c) + -d[0] ?? e"}),
        ("$A = $B;", "x = a.b != c;", {"A": "x", "B": "a.b != c"}),
        ("f($A)", "f(a +\n g<h>('(') * `[${b}`)", {"A": "a +\n g<h>('(') * `[${b}`"}),
        ("f($A, $A)", "f(a(1), a(1))", {"A": "a(1)"}),
        ("f($$$A, $B)", "f(\"(\", [', '], c)", {"A": "\"(\", [', ']", "B": "c"}),
        ("f($A)", "f( (] ) )", None),
        ("f($A)", "f((])", None),
        ("f($A)", "", None),
    ],
)
def test_expressions_beside_quotes_signs_and_stray_brackets(template, code, holes):
    assert matches(template, code)["holes"] == ([holes] if holes else [])


@pytest.mark.parametrize("unit", ["f(", "f(a, ", "f<", "a<b ", "f([{", "f)", "'", '"', "`", "f(1, 2) ", "a<\n"])
@pytest.mark.parametrize("template", ["f($$$A, $LAST)", "type $N = $T", "f($X)"])
def test_time_follows_the_length(unit, template):
    def seconds(times):
        start = time.perf_counter()
        matches(template, "type x = " + unit * times)
        return time.perf_counter() - start

    assert seconds(8_000) < 2.5 * seconds(4_000) + 0.2


def test_templates_on_one_content_look_through_it_once(spark):
    from changelens.functions import code

    texts = ["f(a);\nconst x = g(1);", "const y = 2;", "", None, "nothing", "f(1); f(<T>)"]
    forms = [("f($$$ARGS)", None), ("const $NAME = $VALUE;", None), ("const $NAME = $VALUE;", "VALUE")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    together = [c.alias(f"c{i}") for i, c in enumerate(code.template_extracts(F.col("t"), forms))]
    alone = [code.template_extract(F.col("t"), *form).alias(f"c{i}") for i, form in enumerate(forms)]
    found = rows.select("i", *together)
    assert found._jdf.queryExecution().executedPlan().toString().count("found(") == 1
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.select("i", *alone).collect()))
