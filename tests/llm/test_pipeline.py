import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from capturelake.llm.queries import queries, vocabulary
from capturelake.llm.scratch import Scratch, settings

from .test_minhash import components
from .test_substring import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve groups of twins, passages that repeat, and junk that is labelled as such."""
    import random

    rng, out = random.Random(1), str(tmp_path_factory.mktemp("tables"))
    good, bad = [f"w{k}" for k in range(80)], [f"j{k}%%" for k in range(40)]
    passage, rows, labels = [rng.choice(good) for _ in range(40)], [], []
    for k in range(400):
        junk = k % 4 == 3
        words = [rng.choice(bad if junk else good) for _ in range(rng.randint(40, 90))]
        if not junk and k % 10 == 0:
            words[10:10] = passage
        if not junk and k % 30 == 2 and rows:
            words = rows[-2][1].split() + ["more"]
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, int(not junk), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, rows


def test_stages_equal_brute_force(spark, folder):
    import corpus_pipeline

    out, rows = folder
    kept = [(i, t) for i, t, *_ in rows if i % 4 != 3]
    near = components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if near[i][1] == i]
    slim = brute(kept, 13)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {i: [*library.encode(slim[i][2] if slim[i][1] else t, add_special_tokens=False).ids, 1] for i, t in kept}
    got = {}
    for r in corpus_pipeline.run(spark, out).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == want.keys()
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = want[i][at : at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
            at += r.length
        assert at == len(want[i])


def test_stages_keep_columns_and_take_nothing(spark, folder):
    import corpus_pipeline

    out, _ = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, out).count() == 0
        if name != "packing":
            assert stage(spark, docs, out).columns == docs.columns


def test_extra_columns_and_nulls(spark, folder):
    import corpus_pipeline
    from pyspark.sql import functions as F

    out, rows = folder
    docs = spark.read.parquet(f"{out}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "w1 w2 w3", None, None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9001, None, None, None, None)], docs.schema)
    docs = docs.unionByName(odd).withColumns({c: F.lit("mine") for c in ("score", "kept", "component_id", "spans", "copy_of", "found", "h", "i", "_quality", "_Kept", "_removed", "_text_hash", "x0", "a.b", "the_text", "loss_from", "part", "again")})
    # one id for two texts that are far from each other, one that has near texts, and one that is near to another's
    words = [f"v{k}" for k in range(60)]
    docs = docs.unionByName(docs.where("doc_id = 9002").limit(1).withColumn("doc_id", F.lit(9100).cast("long")).withColumn("text", F.explode(F.array(F.lit(" ".join(words)), F.lit(" ".join(words[:59])), F.lit(" ".join(f"u{k}" for k in range(40)))))))
    docs = docs.unionByName(docs.where("doc_id = 9002").limit(1).withColumn("doc_id", F.lit(9101).cast("long")).withColumn("text", F.explode(F.array(F.lit(" ".join(words[1:])), F.lit(" ".join(f"t{k}" for k in range(40)))))))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, out)
        assert name == "packing" or got.columns == docs.columns
        assert {9001, 9002} <= {r["doc_id"] for r in got.select("doc_id").collect()} or name == "quality"
        if name == "minhash":
            texts = [(r["doc_id"], r["text"].split()[0][0], r["a.b"], r["loss_from"]) for r in got.where("doc_id BETWEEN 9100 AND 9101").collect()]
            assert sorted(texts) == [(9100, "u", "mine", "mine"), (9100, "v", "mine", "mine"), (9101, "t", "mine", "mine")]
        if name == "substring":
            assert sorted(len(r["text"].split()) for r in got.where("doc_id = 9101").collect()) == [0, 40] and got.where("doc_id = 9101 AND text = ''").first()["n_chars"] == 0
            assert sorted(len(r["text"].split()) for r in got.where("doc_id = 9100").collect()) == [40, 59, 60]
        if name == "minhash":
            assert got.where("doc_id = 9001").count() == 1 and got.where("doc_id IS NULL").count() == 1


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture
def no_broadcasts(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        yield


def long_texts(n, twins, again):
    """Texts that don't compress, of which some have a twin with another id, and some rows come twice."""
    import random

    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(300))) for k in range(n)]
    return rows + [(n + k, rows[k][1] + " more") for k in range(twins)] + rows[n - again :]


def test_only_texts_that_go_or_repeat_are_moved(spark, tmp_path, no_broadcasts):
    import corpus_pipeline

    rows = long_texts(600, 20, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.minhash(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    before = shuffled(spark)
    out.write.parquet(f"{tmp_path}/out")
    moved, size = shuffled(spark) - before, sum(len(t) for _, t in rows)
    assert 0 < moved < 0.25 * size
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == rows[:600]


def test_sets_to_confirm_are_moved_once(spark, no_broadcasts):
    from capturelake.llm import minhash

    # no two of these rows are near, but all of them are to be compared
    docs = spark.createDataFrame(long_texts(400, 0, 0), "doc_id long, text string")
    reps = minhash.signatures(docs, 5).withColumn("node", F.col("doc_id"))
    pairs, sizes, save = spark.range(0, 400, 2).selectExpr("id AS a", "id + 1 AS b"), {}, Scratch.save

    class Counted(Scratch):
        def save(self, df, name, **values):
            before = shuffled(spark)
            made = save(self, df, name, **values)
            sizes[name] = shuffled(spark) - before
            return made

    assert minhash.confirm(Counted(spark, "t"), docs, reps, pairs, 5, 80, "x").count() == 0
    # random texts are joined with the ids that are needed, then their sets of 8 bytes a word with the nodes
    texts, sets = sum(len(t) for _, t in long_texts(400, 0, 0)), 400 * 296 * 8
    assert sizes["x-sets"] < texts + 1.5 * sets


@pytest.mark.parametrize("most", [64, 1 << 26])
def test_a_full_filter_loses_nothing(spark, monkeypatch, no_broadcasts, most):
    import corpus_pipeline
    from capturelake.llm import scratch

    monkeypatch.setattr(scratch, "MOST_BITS", most)
    rows = long_texts(300, 40, 10)
    odd = [(None, "a b c"), (None, "a b c"), (901, None), (901, None), (902, ""), (5, "x y")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    got = corpus_pipeline.minhash(spark, docs, "").collect()
    want = sorted([*rows[:300], *odd[:2], *odd[3:]], key=lambda r: (r[0] or 0, r[1] or ""))
    assert sorted(map(tuple, got), key=lambda r: (r[0] or 0, r[1] or "")) == want


def test_key_filter(spark):
    keys = spark.range(3000).selectExpr("id * 7 AS a", "IF(id % 5 = 0, NULL, id) AS b")
    held = Scratch(spark, "t").save_filter(keys, "f")
    assert keys.where(held.holds("a", "b")).count() == 3000
    assert spark.range(100_000).selectExpr("id AS a", "-1L AS b").where(held.holds("a", "b")).count() < 2000
    none = Scratch(spark, "t").save_filter(keys.where("false"), "f")
    assert not keys.where(none.holds("a", "b")).count() and not keys.where(none.holds("a", "b").isNull()).count()


def test_queries_are_named(spark):
    assert [n for n in queries()] and {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 11))
