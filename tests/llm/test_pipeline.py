"""The pipeline's stages on the small tables, and the queries against their SQL."""

import itertools
import os
import re

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from stationlab.llm import toxicity
from stationlab.llm.common import written
from stationlab.llm.queries import SQL
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    cur = con.execute(SQL[name])
    assert digest([tuple(r) for r in got.collect()], got.columns)[0] == digest(cur.fetchall(), [d[0] for d in cur.description])[0]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    index = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["doc_id"] for r in docs.collect() if index.score(r["text"])[0] < P.REJECT_FROM}
    for name, stage in P.STAGES[:3]:
        out = written(stage(spark, docs, SF))
        assert out.columns == columns and out.count() <= rows
        docs, rows = out, out.count()
        if name == "toxicity":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == clean
    assert docs.select("text").distinct().count() == rows
    mixed = written(P.STAGES[3][1](spark, docs, SF))
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    packed = P.STAGES[4][1](spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_near_duplicate_stage_by_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = [f"w{i}" for i in range(100)]
    for at, changed in enumerate(((), (30, 60), (20, 40, 60, 80))):  # copies with no, two and four changed words
        texts[10**9 + at] = " ".join("other" if i in changed else w for i, w in enumerate(base))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in P.near_duplicates(spark, df, SF).collect()}
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small and 100 * small >= 80 * large and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    assert got == {i for i in sets if find(i) == i}
    assert {10**9, 10**9 + 2} <= got and 10**9 + 1 not in got


def test_empty_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
