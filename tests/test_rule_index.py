"""The rule index against rules as literals, and its plan."""

import random

import pytest

from changelens.plans.reports import Rule, match_rules
from changelens.plans.rule_index import ANY, glob_key, index_of, match_rule_index

PATHS = ["a/b/c.ts", "a/b.ts", "c.ts", "a/.x/y.ts", ".hidden", "a/b/package.json", "package.json", "a{1}/q.d.ts", "x.tar.gz", "a/[b]/c.ts", "a//c.ts", "a/b/", "", "é/ü.ts"]
GLOBS = ["**", "*", "**/*.ts", "a/**", "a/b/*.ts", "a/*/c.ts", "**/package.json", "package.json", "!a/**", "!**/*.ts", "#x", "a/{b,.x}/*", "{a,b}/**/*.{ts,js}",
         "**/*.tar.gz", "*.d.ts", "**/.x/*", "a/\\[b\\]/*", "a/[[]b]/*", "?/b.ts", "a/b/c.ts", "{1..3}", "**/*.[tj]s", ".*", "a/b/", "é/*", "!!a/*", "**/q.*.ts", ""]


def changes(spark, paths):
    rows = [(None if i % 3 == 0 else p, None if i % 3 == 1 else p, "modify") for i, p in enumerate(paths * 3)]
    return spark.createDataFrame(rows, "old_path string, new_path string, type string")


def rows(df):
    return sorted(map(str, df.collect()))


def rule(i, include):
    return Rule(f"c{i}", i, 0, tuple(include), "regex", {"pattern": "a"})


@pytest.mark.parametrize("seed", range(2))
def test_same_as_literals(spark, seed):
    rng = random.Random(seed)
    rules = [rule(i, [g]) for i, g in enumerate(GLOBS)] + [rule(99, rng.sample(GLOBS, rng.randint(1, 4))) for _ in range(30)]
    asked = changes(spark, PATHS)
    assert rows(match_rule_index(asked, index_of(spark, rules))) == rows(match_rules(asked, rules))


def test_keys_are_narrow():
    assert glob_key("a/b/*.ts") == "path:a/b" and glob_key("a/b.ts") == "path:a/b.ts" and glob_key("**/x.json") == "name:x.json"
    assert glob_key("**/*.ts") == "ending:.ts" and glob_key("**") == glob_key("!a/*") == ANY


def test_many_rules_in_one_pass(spark):
    rules = [rule(i, [f"dir{i}/**"] if i % 2 else [f"**/file{i}.txt", f"dir{i}/*"]) for i in range(20_000)]
    paths = [f"dir{i}/sub/file{(i * 7) % 20_000}.txt" for i in range(0, 20_000, 40)]
    found = match_rule_index(changes(spark, paths), index_of(spark, rules))
    want = sum((i % 2) + ((i * 7) % 20_000 % 2 == 0) for i in range(0, 20_000, 40)) * 3
    assert found.count() == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and " Exchange" not in plan and "Cartesian" not in plan


def test_nothing(spark):
    assert match_rule_index(changes(spark, PATHS), index_of(spark, [])).count() == 0
    assert match_rule_index(changes(spark, []), index_of(spark, [rule(0, ["**"])])).count() == 0
