"""Near-duplicate, substring and contamination operators against brute force, with awkward rows."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from skipjack.llm import decontaminate, simhash, substring
from skipjack.llm.components import connected_components

WORDS = "the of and to in is on that red blue green one two three four five six".split()


def make_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    passage = " ".join(rng.choice(WORDS, 30))
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(WORDS, int(rng.integers(5, 60))))
        if k % 4 == 0:
            text = f"{text}\n{passage} {k}"
        if k % 7 == 0 and rows:
            text = rows[-1][1] or ""
        if k % 9 == 0 and rows:
            text = (rows[-1][1] or "") + " x"
        rows.append((k * 3, text, "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "  \t\n", "s"), (1003, "One", None), (1004, "ONE", "s"), (1005, "è à ü 日本 " * 8, "s"), (3, rows[1][1], "s"), (1006, "long " * 3000, "s"), (1007, "long " * 2999 + "end", "s")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns carry the names of results.
    return spark.createDataFrame([(*r, 1, "z") for r in make_rows(5)], "doc_id long, text string, source string, component_id int, items string").repartition(3)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [fingerprint(t) for _, t in rows]
    label = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (rows[i][0] == rows[j][0] or (fps[i] ^ fps[j]).bit_count() <= 3) and label[j] < label[i]:
                    label[i], changed = label[j], True
    want = sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, label, strict=True))
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert got == want


def test_gray_index_against_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(25):
            x = int(b)
            for k in rng.integers(0, 64, int(rng.integers(0, 6))):
                x ^= 1 << int(k)
            fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    index = simhash.GrayIndex((fp % np.uint64(2)).astype(np.int64), fp)
    got = index.links()
    near = (np.bitwise_count(index.fp[:, None] ^ index.fp[None, :]) <= 3) & (index.owner[0][:, None] == index.owner[0][None, :])
    want = np.arange(len(fp))
    for _ in range(len(fp)):
        want = np.array([want[near[i]].min() for i in range(len(fp))])
    assert (got == want).all()


def test_a_hot_bucket_is_dealt_on(spark):
    """Fingerprints around one centre and their neighbours' neighbours: no bucket above the bound, no link lost."""
    rng = np.random.default_rng(8)
    centre, fps = 0x0123456789ABCDEF, set()
    while len(fps) < 700:
        x = centre
        for k in rng.integers(0, 64, int(rng.integers(0, 8))):
            x ^= 1 << int(k)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    distinct = spark.createDataFrame([(x,) for x in fps], "fp long")
    dealt = simhash.bucketed(distinct, most=32)
    assert dealt.groupBy("key").count().agg({"count": "max"}).first()[0] <= 32
    assert simhash.bucketed(distinct).count() == 16 * len(fps)
    links = simhash.bucket_links(distinct, most=32).collect()
    own = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(own[:, None] ^ own[None, :]) <= 3

    def settle(joined):
        label = np.arange(len(fps))
        while True:
            new = np.array([label[joined[i]].min() for i in range(len(fps))])
            if (new == label).all():
                return label
            label = new

    place = {x: k for k, x in enumerate(fps)}
    linked = np.eye(len(fps), dtype=bool)
    for r in links:
        linked[place[r["u"]], place[r["v"]]] = linked[place[r["v"]], place[r["u"]]] = True
    assert (settle(linked) == settle(near)).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}
    assert {r["u"]: r["root"] for r in connected_components(frame).collect()} == want
    with pytest.raises(RuntimeError):
        connected_components(frame, max_rounds=1)


def test_hubs_are_split(spark, monkeypatch):
    from skipjack.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    edges = [(500 - k, 999) for k in range(60)] + [(k, k + 1) for k in range(20)] + [(20, 999)]
    got = {r["u"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), heavy=5).collect()}
    assert got == {k: 0 for k in [*range(1, 21), *range(441, 501), 999]}
    right = common.stored(spark.createDataFrame([(1, 9, "a"), (2, 2, "b"), (3, 1, "c")], "k long, n long, x string"), "right")
    left = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0), (2, 1), (3, 0), (4, 0)], "k long, i long")
    want = sorted([(1, i, "a") for i in range(9)] + [(2, 0, "b"), (2, 1, "b"), (3, 0, "c")])
    for heavy in (0, 3, 100):
        assert sorted(tuple(r) for r in common.join_unique(left, right, ["k"], heavy=heavy).collect()) == want


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_near_copies_by_similarity(spark):
    """Five-word shingles, similarity 0.8 or more: the groups that all pairs give."""
    rng = np.random.default_rng(4)
    long = " ".join(f"l{k}" for k in range(20_000))
    vocabulary, rows = [f"v{k}" for k in range(300)], []
    for k in range(40):
        words = rng.choice(vocabulary, int(rng.integers(60, 200))).tolist()
        rows.append((k * 100 + 50, " ".join(words)))
        for j in range(int(rng.integers(0, 4))):
            other = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(1, 2 + len(words) // 25))):
                other[at] = f"x{k}{j}{at}"
            rows.append((k * 100 + 51 + j, " ".join(other).upper() if j == 2 else " ".join(other)))
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  two"), (9004, "one two three"), (50, rows[3][1]), (None, rows[0][1]), (9005, long), (9006, long + " end")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, row int, samples string").repartition(4)
    out = simhash.near_duplicates(docs, size=5, similarity=0.8).collect()
    sets = [shingle_set(t) for _, t in rows]
    like = np.array([[(a == b) if not (a or b) else len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    ids = [d for d, _ in rows]
    label = np.array([10**6 if d is None else d for d in ids])
    for _ in range(len(rows)):
        label = np.array([label[like[i]].min() for i in range(len(rows))])
    want = sorted((d or -1, int(c)) for d, c in zip(ids, label, strict=True))
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in out)
    groups = lambda pairs: sorted(sorted(d for d, x in pairs if x == c) for c in {c for _, c in pairs})
    # A repeated id lies in two groups of texts: compare by the others.
    alone = {d for d in ids if ids.count(d) == 1 and d is not None}
    assert groups([p for p in got if p[0] in alone]) == groups([p for p in want if p[0] in alone])
    assert len(got) == len(rows) and len({c for _, c in got}) < len(rows) - 20


@pytest.mark.parametrize("dealt", [20_000, 4])
def test_no_near_copy_depends_on_a_sample(spark, monkeypatch, dealt):
    """Of three texts the first is like neither of the others, which are alike but may share their samples with it only."""
    monkeypatch.setattr(simhash, "DEALT", dealt, raising=False)
    rng, rows = np.random.default_rng(8), []
    for k in range(300):
        base = [f"w{k}x{i}" for i in range(100)]
        for j, spots in enumerate(([5, 14, 23], [], [50, 60])):
            rows.append((len(rows), " ".join(f"y{k}z{i}" if i in spots else w for i, w in enumerate(base))))
    # Sets that meet in the buckets of one passage and are not alike.
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(len(rows) + k, f"{passage} " + " ".join(rng.choice(5000, 20).astype(str))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = simhash.near_duplicates(docs, size=5, similarity=0.8, row_col="doc_id").collect()
    # Fingerprints link as well.
    fp = [r["fp"] & (2**64 - 1) for r in sorted(out, key=lambda r: r["doc_id"])]
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3
    want = {d: d for d, _ in rows}
    for d in range(0, 900, 3):
        want[d + 1] = want[d + 2] = d if near(d, d + 1) or near(d, d + 2) else d + 1
    assert sum(d == c for d, c in want.items()) > 600
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_meetings_against_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(30):
        sets = [np.unique(rng.integers(0, 40, int(rng.integers(1, 25)))) for _ in range(30)]
        sets += [np.unique(np.append(s[: max(1, len(s) - 1)], 50 + trial)) for s in sets]
        root = rng.integers(0, 1 + 4 * trial, len(sets))
        sizes = np.array([len(s) for s in sets])
        owner, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets).astype(np.uint64)
        often = (np.arange(0, 40, 3).astype(np.uint64), rng.integers(3, 9, 14))
        key, most = simhash.prefixes(owner, h, sizes, 0.8, often)
        row = np.repeat(np.arange(len(sets)), most)
        place = np.arange(len(key)) - np.repeat(np.cumsum(most) - most, most)
        found = {(int(a), int(b)) for part in simhash.meetings(key.astype(np.int64), row, root[row], sizes[row], place, 0.8) for a, b in part}
        bits = simhash.parities(owner, h * np.uint64(0x9E3779B97F4A7C15), sizes)
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert simhash.apart([bits[a]], [bits[b]])[0] <= sizes[a] + sizes[b] - 2 * both
                if root[a] != root[b] and both >= 0.8 * (sizes[a] + sizes[b] - both):
                    assert (a, b) in found and both >= simhash.needed(sizes[a], sizes[b], 0.8)
        assert all(root[a] != root[b] for a, b in found)


def test_buckets_give_forests_against_brute_force():
    """Each bucket's links span what its allowed pairs span, with fewer links than entries; failed pairs are left out."""
    rng = np.random.default_rng(4)
    for trial in range(20):
        base = rng.choice(200, 60, replace=False)
        sets = [np.unique(np.append(rng.choice(base, 57, replace=False), 300 + k % 7)) for k in range(60)]
        sizes, root = np.array([len(s) for s in sets]), np.arange(60) // (1 + trial % 3)
        owner, h = np.repeat(np.arange(60), sizes), np.concatenate(sets).astype(np.uint64)
        bits = simhash.parities(owner, h * np.uint64(0x9E3779B97F4A7C15), sizes)
        key, row = np.repeat([5, 9], 60), np.tile(np.arange(60), 2)
        failed = [[r + 1, r + 2] if r % 4 == 0 and r < 58 else None for r in row]
        args = (key, row, root[row], sizes[row], np.zeros(120, np.int64), [bits[r] for r in row], failed, 0.8)
        whole = {tuple(x) for part in simhash.spanned(*args, whole=True) for x in zip(*(a.tolist() for a in part), strict=True)}
        found = [tuple(x) for part in simhash.spanned(*args) for x in zip(*(a.tolist() for a in part), strict=True)]
        assert set(found) <= whole and len(found) == len(set(found)) < 120 < len(whole)
        assert not any(a % 4 == 0 and a < b <= a + 2 and a < 58 for _, a, b in whole)
        for a in range(60):
            for b in range(a + 1, 60):
                both = len(np.intersect1d(sets[a], sets[b]))
                if root[a] != root[b] and both >= 0.8 * (sizes[a] + sizes[b] - both) and not (a % 4 == 0 and b <= a + 2 and a < 58):
                    assert {(5, a, b), (9, a, b)} <= whole
        for k in (5, 9):
            spans = []
            for links in (whole, found):
                own = root.copy()
                for _, a, b in [x for x in links if x[0] == k]:
                    own[own == max(own[a], own[b])] = min(own[a], own[b])
                spans.append(own.tolist())
            assert spans[0] == spans[1]


def test_no_table_holds_the_pairs_of_a_passage(spark, monkeypatch):
    """Texts that share a passage meet in its buckets; what is stored grows with their entries, not with their pairs."""
    rows, counts, own = [], [], simhash.stored
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(k, f"{passage} " + " ".join(f"w{k}x{i}" for i in range(24))) for k in range(300)]

    def counted(df, name):
        out = own(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5, similarity=0.8, row_col="doc_id").collect()
    assert len(out) == 300 and len({r["component_id"] for r in out}) > 280  # a few fingerprints link
    assert max(counts) <= 300 * 26  # the prefixes' entries; there are 44,850 pairs


def test_links_that_fail_hide_no_other(spark, monkeypatch):
    """Coarse parities let pairs pass that are not alike; the rounds still find every alike pair and no other."""
    fine = simhash.parities
    monkeypatch.setattr(simhash, "parities", lambda owner, h, sizes: [b"\0" * 8] * len(fine(owner, h, sizes)))
    monkeypatch.setattr(simhash, "sample_links", lambda texts, own, firsts, similarity, size: texts.sparkSession.createDataFrame([], "u long, v long"))
    rng, rows = np.random.default_rng(6), []
    for k in range(12):
        base = [f"g{k % 3}w{i}" for i in range(60)]
        for _ in range(6):
            spots = set(rng.choice(60, int(rng.integers(1, 4)), replace=False).tolist())
            rows.append((len(rows), " ".join(f"y{len(rows)}z{i}" if i in spots else w for i, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = simhash.near_duplicates(docs, size=5, similarity=0.8, row_col="doc_id").collect()
    fp = [r["fp"] & (2**64 - 1) for r in sorted(out, key=lambda r: r["doc_id"])]
    texts = [t.encode() for _, t in rows]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3 or simhash.alike([texts[a]], [texts[b]], 5)[0] >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert 3 < len(set(want)) < len(rows) - 10
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(enumerate(want))


def brute_cut(rows, size=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_removal(docs, batches):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = substring.deduplicate_substrings(docs, batches=batches).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_cut(rows)
    for r in out:
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r["kept_text"] or "")).encode()).hexdigest() == r["kept_sha256"]


def test_index_is_incremental_and_compacts(spark, docs):
    index = substring.FingerprintIndex(spark, buckets=3, fan_in=1)
    posts = spark.createDataFrame(substring.profile(docs.selectExpr("doc_id", "text", "monotonically_increasing_id() row")).selectExpr("explode(h) h", "0 call", "row").collect(), "h long, call int, row long")
    shared = set()
    for k in range(3):
        shared |= {r["h"] for r in index.append(posts.where(f"row % 3 = {k}")).collect()}
    assert len(index.runs) == 1 and len(index.merged) == 4
    index.sweep()
    want = {r["h"] for r in posts.groupBy("h").agg({"row": "min"}).join(posts.groupBy("h").agg({"row": "max"}), "h").where("`min(row)` < `max(row)`").collect()}
    assert shared == want
    assert sorted(tuple(r) for r in index.postings().collect()) == sorted(tuple(r) for r in posts.collect())


def test_folding_loses_no_shared_anchor(spark):
    rows = [(1, 0, [5, 6]), (1, 1, [5, 9]), (2, 2, [6, 7]), (3, 3, []), (4, 4, [8])]
    out = substring.fold(spark.createDataFrame(rows, "doc_id long, row long, h array<long>").coalesce(1)).collect()
    post = sorted(h for r in out for h in r["post"])
    assert post == [5, 6, 7, 8, 9]
    assert {r["row"]: sorted(r["own"]) for r in out} == {0: [5, 6], 1: [5], 2: [6], 3: [], 4: []}


def test_an_index_is_opened_again(spark, docs, tmp_path):
    """A later session continues from the folder; a call that breaks off changes nothing."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    path = str(tmp_path / "index")
    got = []
    for k, part in enumerate(("doc_id < 60", "doc_id >= 60 AND doc_id < 120", "doc_id >= 120")):
        index = substring.FingerprintIndex(spark, path, fan_in=1)
        assert len(index.calls) == k
        out = substring.deduplicate_substrings(docs.where(part), index=index).collect()
        got += [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out]
        before = (index.runs, index.count, index.calls)
        with pytest.raises(Exception, match="evaluated"):
            substring.deduplicate_substrings(docs.selectExpr("doc_id", "CASE WHEN doc_id = 3 THEN raise_error('evaluated') ELSE text END AS text"), index=index)
        assert (index.runs, index.count, index.calls) == before
        for run in index.runs:  # a new session knows no table of it
            spark.sql(f"DROP TABLE IF EXISTS {index._name(run)}")
    assert sorted(got) == brute_cut(rows)
    substring.FingerprintIndex(spark, path).drop()
    assert not (tmp_path / "index").exists()


def test_hot_passages_and_copies(spark, monkeypatch):
    """A passage in a third of all rows, whole copies and rows without an id, with every key taken for a hot one."""
    from skipjack.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(substring, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(7)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    passage, copy = say(30), say(40)
    rows = [(k, f"{say(6)} {passage} {say(9)}" if k % 3 == 0 else copy if k % 3 == 1 else say(50)) for k in range(90)]
    rows += [(None, f"{say(5)} {passage}") for _ in range(20)] + [(None, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate_substrings(docs, batches=3).collect())
    assert got == brute_cut([(-1 if d is None else d, t) for d, t in rows])


def test_later_calls_meet_what_the_index_holds(spark, docs):
    """Two calls with one index give what a brute-force run over all documents gives."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    index = substring.FingerprintIndex(spark, buckets=3, fan_in=2)
    got = []
    for part in ("doc_id < 90", "doc_id >= 90"):
        out = substring.deduplicate_substrings(docs.where(part), index=index).collect()
        got += [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out]
    assert sorted(got) == brute_cut(rows)
    assert sum(n for d, _, n, _ in got if d >= 90) > sum(n for _, _, n, _ in brute_cut([r for r in rows if r[0] >= 90]))
    # Whatever its id: a passage and a whole text of the first calls, and words of its own.
    old = next(t for d, t in rows if d == 0)
    fresh = " ".join(f"w{k}" for k in range(20))
    late = spark.createDataFrame([(-5, f"{fresh} {old}"), (None, old), (-4, fresh)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring.deduplicate_substrings(late, index=index).collect()}
    assert out[-5]["n_removed"] == len(old.split()) and out[-5]["kept_text"].split() == fresh.split()
    assert out[None]["n_removed"] == out[None]["n_words"] == len(old.split())
    assert out[-4]["n_removed"] == 20
    with pytest.raises(ValueError):
        substring.deduplicate_substrings(late, index=index, size=8)
    index.drop()


def brute_hits(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in rows:
        w, hit, ids = cut(t), set(), set()
        for item, text in items:
            b = cut(text)
            n = min(8, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    ids.add(item)
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 10])
def test_contamination(spark, docs, limit):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    long = next(t for _, t in rows if t and "\n" in t)
    items = [("10", long), ("9", " ".join(long.split()[3:13])), ("8", "ONE"), ("7", None), ("6", "!!"), ("5", "è, à. ü"), ("9", "red blue")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    merged = brute_hits(rows, items)
    out = decontaminate.find_contamination(docs, bench, max_patterns=limit).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out) == merged
    texts = dict(rows)
    for r in out:
        words = sum(len(decontaminate.normal_words(texts[r["doc_id"]][s["start"] : s["end"]].encode())) for s in r["spans"])
        assert words == r["n_hit"]


@pytest.mark.parametrize("limit", [10**6, 10])
def test_benchmark_items_without_an_id(spark, limit):
    """They are hit like any other, as OP5_SQL has it: together one item, without a name."""
    duckdb = pytest.importorskip("duckdb")
    from skipjack.llm.queries import OP5_SQL

    say = lambda *spans: " ".join(f"w{k}" for a, z in spans for k in range(a, z))
    rows = [(1, say((0, 20))), (2, say((5, 30), (100, 115))), (3, say((200, 230))), (4, say((100, 120))), (5, None)]
    items = [(None, say((0, 12))), (None, say((20, 30))), ("7", say((100, 112))), ("8", say((300, 310)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id string, text string"), max_patterns=limit).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(i for i in r["items"] if i is not None).encode()).hexdigest()) for r in out)
    with duckdb.connect() as db:
        for name, columns, table in (("documents", "doc_id BIGINT, text VARCHAR", rows), ("benchmark", "item_id VARCHAR, text VARCHAR", items)):
            db.execute(f"CREATE TABLE {name} ({columns})")
            db.executemany(f"INSERT INTO {name} VALUES (?, ?)", table)
        assert got == sorted(r[:5] for r in db.execute(OP5_SQL).fetchall())
    assert [r[2:4] for r in got] == [(12, 1), (22, 2), (0, 0), (12, 1), (0, 0)]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert substring.deduplicate_substrings(none).count() == 0
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.find_contamination(docs, bench).collect())
