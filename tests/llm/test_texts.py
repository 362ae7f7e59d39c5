"""Line dedup, decontamination, near dedup and repetition rules against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from tests.llm.tables import awkward, documents, words
from tillroll.llm import decontamination
from tillroll.llm.components import components
from tillroll.llm.decontamination import WuManber, contamination_query, find_contamination, search, matchers, words_of
from tillroll.llm.linededup import PerfectHash, dedup_lines, line_dedup_query
from tillroll.llm.neardedup import band_count, estimate, group_links, keep_one, near_dedup_query, placed_members, sketch, text_sets
from tillroll.llm.repetition import judge, maximal_repeats, repetition_of, suffix_array
from tillroll.llm.words import shingles, word_hashes

BLANK = " \t\n\x0b\x0c\r"


def folded(text):
    return text.encode().lower().decode()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_word_hashes_split_like_bytes():
    texts = [(t or "").encode() for _, t in awkward()]
    hashes, counts = word_hashes(texts, lower=False)
    assert counts.tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_long_text_is_hashed_in_pieces(monkeypatch):
    import tillroll.llm.words as module

    text = words(random.Random(1), 500).encode()
    whole, _ = word_hashes([text], lower=True)
    monkeypatch.setattr(module, "PIECE", 100)
    assert word_hashes([text], lower=True)[0].tolist() == whole.tolist()


def test_shingles_of_short_texts():
    sets = shingles(*word_hashes([b"a b c d", b"A B", b"a b", b"", b"b a"], lower=True), 3)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 1]
    assert sets[1].tolist() == sets[2].tolist() != sets[4].tolist()


# --- line dedup


def line_brute(table):
    top = 2**63 - 1
    keys = {}
    for doc, text in table:
        for line in (text or "").split("\n"):
            key = folded(line.strip(BLANK))
            if len(key) >= 10:
                keys.setdefault(key, set()).add(top if doc is None else doc)
    out = []
    for doc, text in table:
        lines = (text or "").split("\n")
        me = top if doc is None else doc
        stay = [x for x in lines if len(k := folded(x.strip(BLANK))) < 10 or min(keys[k]) == me]
        out.append((doc, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


def test_line_dedup_brute(spark):
    rng = random.Random(5)
    pool = [words(rng, rng.randrange(1, 6)) for _ in range(60)]
    table = awkward() + [(100 + i, "\n".join(rng.choices(pool, k=rng.randrange(8)))) for i in range(80)]
    assert rows(line_dedup_query(documents(spark, table))) == line_brute(table)


def test_shards_follow_the_probes(spark, monkeypatch):
    """Many lines of which few come back: no single shard is asked for all of them."""
    import tillroll.llm.linededup as module

    counts, count = [], module.shard_count
    monkeypatch.setattr(module, "SHARD_PROBES", 50)
    monkeypatch.setattr(module, "shard_count", lambda *a: counts.append((*a, count(*a))) or counts[-1][-1])
    table = awkward() + [(100 + i, "\n".join(f"line {i} number {j} of its own" for j in range(20)) + "\na line that comes back") for i in range(100)]
    assert rows(line_dedup_query(documents(spark, table))) == line_brute(table)
    (keys, probes, shards), = counts
    assert keys < 10 and probes >= 2100 and shards == probes // 50
    assert line_dedup_query(documents(spark, []).limit(0)).count() == 0


def test_line_dedup_hands_columns_through(spark):
    docs = documents(spark, awkward())
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert out.where("shard = 99 AND n_words = 'x'").count() == docs.count()
    assert dedup_lines(docs.limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (5000, 2), dtype=np.uint64)
    table = PerfectHash.load(PerfectHash.build(keys, np.arange(5000), np.arange(5000) * 3).dump())
    assert sorted(table.index(keys).tolist()) == list(range(5000))
    found, owner = table.probe(keys)
    assert found.tolist() == list(range(5000)) and owner.tolist() == (np.arange(5000) * 3).tolist()
    assert not len(table.probe(rng.integers(0, 2**63, (5000, 2), dtype=np.uint64))[0])
    assert not len(PerfectHash.build(keys[:0], keys[:0, 0], keys[:0, 0]).probe(keys)[0])


# --- decontamination


def hits_brute(text, items, window=13):
    w = [x.encode() for x in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded(text or ""))]
    hit, names = set(), set()
    for name, item in items:
        p = words_of(item)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit.update(range(j, j + m))
                    names.add("null" if name is None else str(name))
    return len(w), hit, sorted(names)


def test_wu_manber_finds_all():
    rng = random.Random(2)
    for m in (1, 2, 3, 5):
        for _ in range(60):
            text = [bytes([rng.choice(b"ab")]) for _ in range(40)]
            patterns = {tuple(bytes([rng.choice(b"ab")]) for _ in range(m)): {str(i)} for i in range(3)}
            want = [i for i in range(len(text) - m + 1) if tuple(text[i : i + m]) in patterns]
            assert [i for i, _ in WuManber(m, patterns).find(text)] == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination_brute(spark, block_bytes):
    rng = random.Random(4)
    items = [(i, words(rng, rng.choice([1, 5, 13, 14, 40]), 50)) for i in range(12)]
    items += [(3, words(rng, 20)), (None, words(rng, 15)), (77, None), (78, ""), (79, "!!")]
    table = awkward()
    for i in range(40):
        p = (rng.choice(items)[1] or "").split()
        a = rng.randrange(len(p) + 1)
        table.append((200 + i, f"{words(rng, 20)}, {' '.join(p[a:]).upper()}; {words(rng, 5)}"))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    out = find_contamination(documents(spark, table).select("doc_id", "text", "shard"), benchmark, block_bytes=block_bytes)
    got = sorted(
        ((r.doc_id, r.n_words, sum(b - a for a, b in r.hits), list(r["items"])) for r in out.collect()), key=repr
    )
    want = [(d, *hits_brute(t, items)) for d, t in table]
    assert got == sorted(((d, n, len(h), k) for d, n, h, k in want), key=repr)
    verdict = {(r.doc_id, r.n_words): r.contaminated for r in contamination_query(documents(spark, table), benchmark).collect()}
    for d, n, h, _ in want:
        assert verdict[d, n] == (len(h) > 0 and 20 * len(h) >= n)


@pytest.mark.parametrize("turn,run", [(16, 1 << 25), (16, 300), (2, 300)])
def test_blocks_of_a_benchmark_agree_with_one(spark, monkeypatch, turn, run):
    rng = random.Random(9)
    items = [(i, words(rng, rng.choice([3, 14, 30]), 50)) for i in range(20)]
    texts = [f"{words(rng, 20)} {rng.choice(items)[1]} {rng.choice(items)[1]}" for _ in range(60)]
    docs, benchmark = documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda **how: rows(find_contamination(docs, benchmark, **how).select("doc_id", "n_words", "hits", "items", "shard"))
    one = found()
    monkeypatch.setattr(decontamination, "TURN_BLOCKS", turn)
    monkeypatch.setattr(decontamination, "RUN_BYTES", run)
    assert len(list(decontamination.blocks_of(benchmark, 1000))) > 3
    assert found(block_bytes=1000) == one


def test_documents_are_read_once_for_several_blocks(spark, tmp_path):
    path = str(tmp_path / "documents")
    documents(spark, ["a b c", "d e f"]).write.parquet(path)
    benchmark = spark.createDataFrame([(i, f"a b {i}") for i in range(3)], "item_id bigint, text string")
    assert len(list(decontamination.blocks_of(benchmark, 1))) == 3
    found = find_contamination(spark.read.parquet(path), benchmark, block_bytes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 1
    assert "Exchange" not in plan


def test_contamination_empty_tables(spark):
    docs = documents(spark, awkward())
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination_query(docs, benchmark).where("contaminated OR n_items > 0").count() == 0
    assert contamination_query(docs.limit(0), benchmark).count() == 0
    assert search([b"a"], matchers([])) == ([], set())


# --- near dedup


def near_brute(table, k, percent):
    sets = []
    for _, text in table:
        w = folded(text or "").encode().split()
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        sets.append(s or ({tuple(w)} if w else set()))
    parent = list(range(len(table)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [i for i, (d, _) in enumerate(table) if d is not None]
    for a in named:
        for b in named:
            same = table[a][0] == table[b][0]
            c = len(sets[a] & sets[b])
            if same or c and 100 * c >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i in named:
        least[root(i)] = min(least.get(root(i), 2**63), table[i][0])
    out = []
    for i, (d, _) in enumerate(table):
        comp = None if d is None else least[root(i)]
        out.append((d, len(sets[i]), comp, d is None or d == comp))
    return sorted(out, key=repr)


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def near_table(rng):
    table = awkward()
    for g in range(6):
        base = words(rng, 150, 2000)
        table.append((1000 + 100 * g, base))
        share = rng.choice([0.01, 0.02, 0.04, 0.06])
        table += [(1001 + 100 * g + i, edited(rng, base, share)) for i in range(25)]
        table += [(1050 + 100 * g + i, base) for i in range(3)]
    return table


def test_near_dedup_brute(spark):
    table = near_table(random.Random(6))
    assert rows(near_dedup_query(documents(spark, table))) == near_brute(table, 3, 85)


def test_near_dedup_crowds(spark, monkeypatch):
    """Small limits send most pairs through the block comparison."""
    import tillroll.llm.neardedup as module

    monkeypatch.setattr(module, "SMALL", 2)
    monkeypatch.setattr(module, "BLOCK_SETS", 8)
    table = near_table(random.Random(7))
    want = near_brute(table, 3, 85)
    assert rows(near_dedup_query(documents(spark, table))) == want
    monkeypatch.setattr(module, "SPREAD", 1)  # groups of several blocks
    monkeypatch.setattr(module, "BLOCK_SETS", 3)
    monkeypatch.setattr(module, "GROUP_SETS", 10)
    assert rows(near_dedup_query(documents(spark, table))) == want


def crowd(spark, sizes, n=500):
    """One crowd of components of the given sizes, of classes of n shingles each."""
    members = [(0, 1000 * 1000 * c + i, n, c) for c, size in enumerate(sizes) for i in range(size)]
    frame = pd.DataFrame(members, columns=["crowd", "rep", "n", "component"])
    return spark.createDataFrame(frame, "crowd bigint, rep bigint, n bigint, component bigint")


def test_sets_of_a_crowd_are_sent_few_times(spark):
    alone = placed_members(crowd(spark, [1] * 50_000))
    assert alone.count() < 10 * 50_000
    largest = max(r["count"] for r in alone.groupBy("i", "j").count().collect())
    assert largest < 2.5 * 8192
    strays = placed_members(crowd(spark, [50_000] + [1] * 50))
    assert strays.count() < 1.1 * 50_000


@pytest.mark.parametrize("sizes", [[1] * 9, [5, 1, 1], [4, 4], [30, 2, 1, 7], [1, 1]])
def test_pairs_across_components_meet_once(spark, monkeypatch, sizes):
    import tillroll.llm.neardedup as module

    monkeypatch.setattr(module, "BLOCK_SETS", 2)
    monkeypatch.setattr(module, "GROUP_SETS", 3)
    monkeypatch.setattr(module, "SPREAD", 3)
    members = crowd(spark, sizes)
    component = {r.rep: r.component for r in members.collect()}
    tasks = {}
    for r in placed_members(members).collect():
        tasks.setdefault((r.i, r.j), []).append((r.rep, r.own))
    met = {(p, q) for (i, j), of in tasks.items() for p, g in of for q, h in of if {g, h} == {i, j}}
    for p in component:
        for q in component:
            assert component[p] == component[q] or (p, q) in met


def test_group_links_by_brute_force(monkeypatch):
    import tillroll.llm.neardedup as module

    monkeypatch.setattr(module, "BLOCK_SETS", 4)
    monkeypatch.setattr(module, "BLOCK_ITEMS", 300)
    monkeypatch.setattr(module, "BLOCK_COLUMNS", 16)
    rng = random.Random(31)
    for trial in range(30):
        base = [words(rng, 60, 5000) for _ in range(3)]
        sets = text_sets([edited(rng, rng.choice(base), 0.05) for _ in range(rng.randrange(1, 30))], 3)
        component = [rng.randrange(12) for _ in sets]
        group = [rng.randrange(1 + trial % 2) for _ in sets]
        a, b = group_links(list(range(len(sets))), component, group, [s.tobytes() for s in sets], 70)
        want = [
            (p, q) for p in range(len(sets)) for q in range(p)
            if (group[p] != group[q] or len(set(group)) == 1)
            and 100 * len(np.intersect1d(sets[p], sets[q])) >= 70 * len(np.union1d(sets[p], sets[q]))
        ]
        assert {(max(e), min(e)) for e in zip(a, b)} <= set(want)
        assert joined(component, zip(a, b)) == joined(component, want)


def joined(component, edges):
    """The least component that each one hangs together with, by the edges between their members."""
    label = {c: c for c in component}
    for p, q in edges:
        u, v = label[component[p]], label[component[q]]
        label = {c: min(u, v) if m in (u, v) else m for c, m in label.items()}
    return label


def test_keep_one(spark):
    table = near_table(random.Random(8))
    stay = keep_one(documents(spark, table))
    want = {d for d, _, c, kept in near_brute(table, 5, 80) if kept and d is not None}
    got = [r.doc_id for r in stay.collect()]
    assert sorted(d for d in got if d is not None) == sorted(want)
    assert got.count(None) == 2
    assert keep_one(documents(spark, []).limit(0)).count() == 0


def test_group_links_join_all():
    rng = random.Random(1)
    base = words(rng, 100, 5000)
    sets = text_sets([edited(rng, base, 0.03) for _ in range(40)], 3)
    blocks = [rng.randrange(2) for _ in sets]
    a, b = group_links(list(range(40)), list(range(40)), blocks, [s.tobytes() for s in sets], 70)
    for x, y in zip(a, b):
        assert blocks[x] != blocks[y]
        assert 100 * len(np.intersect1d(sets[x], sets[y])) >= 70 * len(np.union1d(sets[x], sets[y]))
    assert len(a) < 40


def test_estimate_is_near():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.9):
        both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        n = int(2000 * (1 - share) / (1 + share) * 1.0)
        x = np.concatenate([both[n:], rng.integers(0, 2**63, n, dtype=np.uint64)])
        k = sketch([both, x], 1024)
        true = len(np.intersect1d(both, x)) / len(np.union1d(both, x))
        found = estimate(k[:1], k[1:], np.array([2000.0]), np.array([float(len(x))]))[0]
        assert abs(found - true) < 0.07
    merged = np.maximum(*sketch([both, x], 64))
    assert merged.tolist() == sketch([np.union1d(both, x)], 64)[0].tolist()
    assert (1 - 0.85**8) ** band_count(85, 8) <= 1e-6


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    for a, b in edges:
        assert a == b or got[a] == got[b] <= min(a, b)
    assert components(df.limit(0)).count() == 0


# --- repetition rules


def repeats_brute(text, window, least):
    w = text.encode().split()
    n, rep, maximal, cover, most = len(w), set(), 0, set(), 0
    for size in range(1, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(w[i : i + size]), []).append(i)
        for at in places.values():
            if len(at) < 2:
                continue
            most = size
            if size == window:
                rep.update(j for i in at for j in range(i, i + size))
            after = {w[i + size] if i + size < n else None for i in at}
            front = {w[i - 1] if i else None for i in at}
            if size >= least and len(after) > 1 and len(front) > 1:
                maximal += 1
                cover.update(j for i in at for j in range(i, i + size))
    return n, len(rep), maximal, len(cover), most


def test_repetition_brute():
    rng = random.Random(11)
    for _ in range(80):
        texts = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        window, least = rng.choice([(3, 2), (4, 3), (2, 1)])
        r = repetition_of(texts, window, least)
        for i, t in enumerate(texts):
            got = tuple(int(r[c][i]) for c in ("n_words", "n_repeat_words", "n_repeats", "covered", "longest"))
            assert got == repeats_brute(t, window, least)


def test_intervals_cover_what_neighbours_do():
    """The union and the longest of the spans of maximal repeats, as the README says."""
    rng = random.Random(13)
    for _ in range(60):
        text = " ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 60)))
        hashes, counts = word_hashes([text.encode()], lower=False)
        _, codes = np.unique(hashes, return_inverse=True)
        order, common = suffix_array(codes, np.zeros(len(codes), int))
        spans = maximal_repeats(order, common, np.concatenate([[-1], codes[:-1]]), 1)
        cover = {j for low, high, n in spans for i in order[low:high].tolist() for j in range(i, i + n)}
        r = repetition_of([text], 3, 1)
        assert r["covered"][0] == len(cover) and r["longest"][0] == max((n for *_, n in spans), default=0)


def test_quality_rules(spark):
    rng = random.Random(12)
    loop = " ".join(["one two three four five six seven"] * 40)
    table = awkward() + [(50, words(rng, 200)), (51, loop), (52, "x $ #\nx $ #\n  \n" + words(rng, 40)), (53, words(rng, 120, 10**6) * 2)]
    got = {(r.doc_id, r.n_words): r for r in judge(documents(spark, table)).collect()}
    for doc, text in table:
        t = text or ""
        n, rep, _, _, _ = repeats_brute(t, 8, 5) if len(t) < 3000 else (len(t.split()), None, 0, 0, 0)
        r = got[doc, n]
        assert r.word_chars == len(re.sub(r"[\x20\x09-\x0d]", "", t))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        if rep is not None:
            assert r.n_repeat_words == rep
            assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)
    assert got[50, 200].kept and not got[51, 280].kept and got[52, 46].n_dup_lines == 1
    assert judge(documents(spark, table).limit(0)).count() == 0
