"""YAML against the installed library where there is one, and by hand."""

import json
import random

import pytest

from sievework.functions.yaml_text import parse_yaml, yaml_to_json
from sievework.operators import records
from sievework.sources.readers import read_yaml_documents

GOOD = [
    "{steps: [a]}", '"steps":\n  - x\n', "a: 1\nb:\n- x\n- y: 2\n  z: [1, {q: r}]\nc: ~\n", "- - 1\n  - 2\n-\n  a: b\n- c\n", "a: |\n  x\n   y\n\n  z\nb: >\n  f1\n  f2\n\n  g\nc: end\n",
    "a: 'it''s' # c\nb: \"x\\ty # no\"\n", "x: 010\ny: 0x1F\nz: 1_000\nw: 1e3\nv: 1.5e+3\nt: yes\ns: 12:30\n", "[a, b, [c, d]]", "{a: 1, b: {c: [x, 'y, z']}}", "plain multi\n line", "a: multi\n  line value\nb: 2",
    "", "# only\n", "url: http://x.y/z:80\n", "- {a: 1}\n- [2]\n- 'q'\n", "a: {}\nb: []\nc: ''\n", "a:\n\n  # c\n  - 1\n\n  - 2\n", "---\na: 1\n", "a: [x,\n  y]\nb: {c: d,\n e: f}\n", "a: b#c\n",
    "- -1\n- +2\n- 0\n- 1.\n- .5\n", "'a': 1\n\"b c\": 2\n3: x\n", "a: [1, 2,]\n", "a: {x, y: 1}\n", "a: [x: 1, y]\n", "steps:\n- id: 1\n  sites:\n  - x\n- id: 2\n", "a: |-\n  x\n\nb: |+\n  y\n\nc: 1\n",
]
BAD = ["a: [1", "a: b\n c: d", "a:\n  b: 1\n c: 2", "a: - b", "a: @x", "a: `x`", "a: %x", "a: 'x' y", "a: ]", "a: [,]", "a: 'open", "a: \"\\q\"", "a\nb: 1", "a: x: y", "- a\nb: 1", "\ta: 1"]


@pytest.mark.parametrize("text", GOOD + BAD)
def test_as_the_library(text):
    yaml = pytest.importorskip("yaml")
    try:
        wanted = yaml.safe_load(text)
    except yaml.YAMLError:
        wanted = ValueError
    try:
        got = parse_yaml(text)
    except ValueError:
        got = ValueError
    assert repr(got) == repr(wanted)
    assert (wanted is ValueError) == (text in BAD)


def test_what_the_library_writes():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(1)
    leaf = lambda: rng.choice([None, True, 3, -7, 2.5, "", "a b", "x: y", "- z", "it's", '"q"', "# no", "true", "12", "e", "[", "tail ", "é😀", "a\nb\n", "two  blanks"])

    def value(depth):
        kind = rng.random() if depth else 1
        if kind < 0.35:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind < 0.7:
            return {rng.choice(["k", "key two", "3", "x-y", "a:b", "true", "é"]) + str(i): value(depth - 1) for i in range(rng.randrange(4))}
        return leaf()

    for n in range(400):
        wanted = value(4)
        text = yaml.safe_dump(wanted, allow_unicode=True, sort_keys=False, default_flow_style=[None, False, True][n % 3], width=[40, 400][n % 2])
        assert repr(parse_yaml(text.removesuffix("...\n"))) == repr(wanted), text


def test_json_of_documents():
    assert yaml_to_json("b: 1\na: [x, .inf]\n2: é") == '{"b":1,"a":["x","inf"],"2":"é"}'
    assert yaml_to_json("a: [1") is None and yaml_to_json(None) is None and yaml_to_json("") == "null"


def test_contracts(spark):
    from pyspark.sql import functions as F

    texts = ["x\n```yaml\nsteps: [1\n```\n```yml\n{steps: [a]}\n```", '```yaml \n\n"steps":\n- b\n```', "```yaml\n- steps\n```\n```yaml\nsteps: none\n```", "```yaml\nderived_state:\n```", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("b", records.yaml_blocks(F.col("t")))
    got = {r.id: (r.n, r.plan, r.sites) for r in df.select("id", F.size("b").alias("n"), records.contract_block(F.col("b"), ("steps",)).alias("plan"), records.contract_block(F.col("b"), ("sites",), ("derived_state",)).alias("sites")).collect()}
    assert got == {0: (1, '{"steps":["a"]}', None), 1: (1, '{"steps":["b"]}', None), 2: (1, None, None), 3: (1, None, '{"derived_state":null}'), 4: (0, None, None), 5: (0, None, None)}


def test_yaml_files(spark, tmp_path):
    for name, text in {"a.yaml": "x: [1, 2]\n", "b.yaml": "x: [1\n", "c.txt": "x: 3"}.items():
        (tmp_path / name).write_text(text)
    found = {r.path.rsplit("/", 1)[1]: r.json and json.loads(r.json) for r in read_yaml_documents(spark, str(tmp_path / "*.yaml")).collect()}
    assert found == {"a.yaml": {"x": [1, 2]}, "b.yaml": None}


def test_one_plan_is_made_for_an_order(spark, tmp_path):
    from sievework.plans.records import contract_blocks

    spark.createDataFrame([(o, 1 + k, 10 * o + k) for o in range(12) for k in range(2)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = contract_blocks(spark, str(tmp_path))
    assert [r.blocks for r in found.orderBy("l_orderkey").collect()] == [1, 1, 1, 2, 1, 0] * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "element_at(array(concat(" not in plan
