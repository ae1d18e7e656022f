"""The pipeline against brute force, stage by stage, on a small corpus with planted cases."""

import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from skipjack.llm import toxicity  # noqa: E402
from tests.llm.test_dedup import brute_hits, shingle_set  # noqa: E402

WORDS = [f"{a}{b}" for a in ("al", "be", "cor", "da", "ef", "gu") for b in ("na", "to", "ri", "mu", "se")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    passage, items = say(25), [say(20) for _ in range(3)]
    texts = []
    for k in range(120):
        t = say(int(rng.integers(60, 90)))
        if k % 6 == 0:
            t += " vilex awfulz viley vilex"
        if k % 10 == 1:
            t = f"{t} {passage}"
        if k % 15 == 2:
            t = f"{items[0]} {t} {items[1]}"
        if k % 20 == 3:
            t = f"{t} {items[2]}"
        if k % 12 == 5:
            t = texts[-1]
        if k % 12 == 8:  # a near copy: two words changed
            t = " ".join("other" if i in (20, 40) else w for i, w in enumerate(texts[-1].split()))
        texts.append(t)
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "en", "s", 0), (7, texts[7], "en", "s", len(texts[7]))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [[tuple(r) for r in docs.collect()]]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        steps.append([tuple(r) for r in docs.collect()])
    start, clean, single, cut, apart, last = steps
    table = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    key = lambda rows: sorted(rows, key=repr)
    assert key(clean) == key([r for r in start if scores[r[0]] < 0.5])
    assert not any("vilex" in (r[1] or "") for r in clean) and len(clean) > 90
    # Near-duplicates: the least doc_id of each group linked by a similarity of 0.8.
    sets = [shingle_set(r[1]) for r in clean]
    label = [r[0] for r in clean]
    for _ in range(len(label)):
        label = [min(m for m, g in zip(label, sets, strict=True) if len(f & g) >= 0.8 * len(f | g)) for f in sets]
    want = {r[0]: r for r, c in zip(clean, label, strict=True) if r[0] == c}
    assert sorted(r[0] for r in single) == sorted(want) and all(r[1] == want[r[0]][1] for r in single)
    # Passages: windows of 13 words.
    first = {}
    for r in single:
        w = words(r[1])
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, r[0]), r[0])
    for r in single:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < r[0]:
                gone.update(range(i, i + 13))
        left = [x for i, x in enumerate(w) if i not in gone]
        own = [x for x in cut if x[0] == r[0]]
        if w and not left:
            assert not own
        else:
            assert words(own[0][1]) == left and own[0][2:4] == r[2:4]
            assert own[0][4] == (len(own[0][1]) if gone else r[4])
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean_ids = sorted(r[0] for r in brute_hits([(x[0], x[1]) for x in cut], items) if not r[3])
    assert sorted(r[0] for r in apart) == clean_ids and len(apart) < len(cut)
    assert key(apart) == key([r for r in cut if r[0] in set(clean_ids)])
    assert sorted(r[0] for r in last) == clean_ids and all(r[4] for r in last)


def test_rows_without_an_id_of_their_own(spark, folder, tmp_path):
    """Null and repeated doc_ids: each row is judged on its own text, and different texts all stay."""
    rng = np.random.default_rng(12)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = [say(70) for _ in range(9)]
    toxic, leak = say(60) + " vilex awfulz viley vilex", f"{say(40)} {items[1]}"
    extra = [(None, t) for t in texts[:4]] + [(None, texts[0]), (None, toxic), (None, leak)]
    extra += [(500, t) for t in texts[4:7]] + [(500, toxic), (501, texts[4]), (None, texts[7]), (502, texts[7]), (None, texts[8])]
    docs = spark.createDataFrame([(d, t, "en", "more", len(t)) for d, t in extra], COLUMNS)
    docs.unionByName(spark.read.parquet(f"{folder}/documents.parquet")).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs, own = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        own.append(sorted((r["doc_id"] or 0, r["text"]) for r in docs.where("source = 'more'").collect()))
    pairs = lambda rows: sorted((d or 0, t) for d, t in rows)
    assert own[0] == pairs(x for x in extra if x[1] != toxic)
    single = [(None, t) for t in texts[:4]] + [(None, leak)] + [(500, t) for t in texts[4:7]] + [(502, texts[7]), (None, texts[8])]
    assert own[1] == own[2] == pairs(single)
    assert own[3] == pairs(x for x in single if x[1] != leak)


def test_columns_of_any_name_and_long_texts(spark, folder, tmp_path):
    """Extra columns named like what the stages make, and a very long text, pass through unchanged."""
    names = ["_row", "row", "doc", "file", "number", "place", "kept_text", "n_removed", "_id", "_kept", "score", "component_id", "_metadata", "a.b`c"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = " ".join(f"w{k}" for k in range(60_000))
    more = spark.createDataFrame([(900, long, "en", "x", len(long)), (901, "日本" * 40_000, "ja", "x", 80_000)], COLUMNS)
    wide = docs.unionByName(more).selectExpr("*", *[f"concat('{n}', doc_id) AS `{n.replace('`', '``')}`" for n in names])
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, own, str(tmp_path))
        assert out.columns == wide.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        own = spark.read.parquet(f"{tmp_path}/stage{k}")
        for r in own.collect():
            assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for n in names)
    kept = {r["doc_id"]: r["text"] for r in own.collect()}
    assert kept[900] == long and kept[901] == "日本" * 40_000
    last = {r["doc_id"]: r["round_trip"] for r in cp.encode(spark, own, str(tmp_path)).collect()}
    assert last[900] and last[901] and len(last) == len(kept)


def test_run_removes_what_it_no_longer_reads(spark, folder, tmp_path, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(cp, "scratch", lambda *_: str(tmp_path / "run"))
    assert cp.run(spark, folder).count() > 0
    assert [p.name for p in Path(tmp_path / "run").iterdir()] == ["4-sentencepiece"]


def test_run_on_an_empty_table(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
