"""The pipeline, its stages on awkward rows, and the queries that have SQL."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pageloom.llm import langmix, simhash, tokens, toxicity
from pageloom.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(5000, None, None, None, None), (5001, "", "en", None, 0), (None, None, None, "s", None), (5002, "x " * 60_000, "en", "src0", 120_000), (5002, "x " * 60_000, "en", "src0", 120_000)]
    return stored(d.unionByName(spark.createDataFrame(odd, d.schema)), "odd")


def test_stages_keep_the_columns_and_only_drop_or_repeat_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stored(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.columns == COLUMNS
            assert out.exceptAll(docs).dropDuplicates().join(docs, COLUMNS, "left_anti").where("doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL").count() == 0
        assert name in ("mixing", "packing") or out.count() < before
        docs = out
    assert docs.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and docs.count() > 0


def test_stages_keep_columns_of_any_name(spark, docs):
    extra = {c: F.lit("kept") for c in ("row", "score", "found", "lang_pred", "component", "text_hash", "id", "copies", "position", "digest", "__row", "__score", "__found", "__n", "__kept")}
    clash = stored(docs.where("doc_id < 60 OR doc_id IS NULL OR doc_id >= 5000").withColumns(extra), "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, clash, SF), "stage")
        assert out.columns == clash.columns, name
        assert out.exceptAll(clash).dropDuplicates().join(clash.select(*COLUMNS), COLUMNS, "left_semi").where(" OR ".join(f"`{c}` <> 'kept'" for c in extra)).count() == 0
        assert out.select(*extra).distinct().count() == 1 and 0 < out.select(*COLUMNS).distinct().count() <= clash.count()
    assert corpus_pipeline.STAGES[-1][1](spark, clash, SF).count() >= clash.count()


def test_rows_with_one_id_stay_unless_their_texts_are_near(spark, docs):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(3)]
    schema = docs.schema
    df = spark.createDataFrame([(7, texts[0], "en", "a", 1), (7, texts[1], "en", "a", 1), (7, texts[0] + " end", "en", "b", 1), (None, texts[2], "en", "a", 1), (None, texts[2], "en", "a", 1), (8, texts[1], "en", "a", 1)], schema)
    got = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert len(got) == 3 and {g["text"].removesuffix(" end") for g in got} == set(texts) and [g["doc_id"] for g in got if g["text"] == texts[1]] == [7]


def brute_near_duplicates(text):
    """The ids that stay of {id: text}: the smallest of each component at 0.8."""
    sets = {i: np.unique(simhash.shingle_hashes(t, 5)) for i, t in text.items()}
    holders, both, near = {}, {}, {i: {i} for i in text}
    for i, s in sets.items():
        for h in s.tolist() or ["no word"]:
            holders.setdefault(h, []).append(i)
    for ids in holders.values():
        for pair in itertools.combinations(ids, 2):
            both[pair] = both.get(pair, 0) + 1
    for (a, b), n in both.items():
        if n / max(1, len(sets[a]) + len(sets[b]) - n) >= 0.8 or not len(sets[a]):
            near[a].add(b)
            near[b].add(a)
    kept, seen = set(), set()
    for i in sorted(text):
        if i not in seen:
            kept.add(i)
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo += near[j]
    return kept


def test_near_duplicates_of_the_table_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = brute_near_duplicates({x["doc_id"]: x["text"] for x in d.collect()})
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, d, "").collect()} == kept and len(kept) < d.count()


def test_the_pipeline_against_brute_force(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    weights, constant = toxicity.train(d, labels)
    civil = [x["doc_id"] for x in d.collect() if 1 / (1 + np.exp(-constant - sum(weights.get(f, 0) for f in {f for w in toxicity.words_of(x["text"]) for f in toxicity.features_of(w)}))) < 0.3]
    d = d.where(F.col("doc_id").isin(civil))
    langs, model = langmix.train(d)
    known = {x["doc_id"]: (x["text"], x["source"]) for x in d.collect() for lang, score in [langmix.identify(x["text"], langs, model.astype(np.float32).astype(float))] if lang != "und" and score >= 0.5}
    kept = brute_near_duplicates({i: t for i, (t, _) in known.items()})
    size = {i: len((known[i][0] or "").encode().split()) for i in kept}
    sources = sorted({known[i][1] for i in kept}, key=lambda s: (s is None, s or ""))
    total, capped = {s: sum(size[i] for i in kept if known[i][1] == s) for s in sources}, set()
    while True:
        left, weight = sum(total.values()) - sum(3 * total[s] for s in capped), {s: k % 3 + 1 for k, s in enumerate(sources)}
        target = {s: 3 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        if not (over := {s for s in sources if s not in capped and target[s] > 3 * total[s]}):
            break
        capped |= over
    times = {}
    for s in sources:  # passes over the source's documents in the order of their ids' digests
        at, mine = 0, sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in kept if known[i][1] == s)
        for _, i in mine * 3:
            times[i] = times.get(i, 0) + (size[i] > 0 and at < int(target[s]))
            at += size[i]
    encode, want = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), "byte"), Counter()
    for i, n in times.items():
        ids = encode([known[i][0]])[0] + (1).to_bytes(4, "little")
        for start in range(0, len(ids) // 4, 2048):
            piece = ids[4 * start : 4 * (start + 2048)]
            want[i, start, len(piece) // 4, zlib.crc32(piece), len(ids) // 4] += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(x)[:5] for x in got) == +want and len(want) > 50
    room = Counter()
    for x in got:
        room[x["sequence_id"]] += x["length"]
    assert max(room.values()) <= 2048 and sum(room.values()) / len(room) > 0.95 * 2048


def test_every_stage_takes_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    from pageloom.llm.queries import ORACLE_SQL

    for name, sql in ORACLE_SQL.items():
        got = __spark_entry__.queries()[name](spark, SF)
        cur = con.execute(sql)
        at = [[c[0] for c in cur.description].index(c) for c in got.columns]
        want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name
