"""Piece encoding, filter audit, conversation repair."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
from oracle_check import difference

from tests.llm.tables import awkward, documents, words
from tillroll.llm import conversations as conv
from tillroll.llm import filteraudit as audit
from tillroll.llm import sentencepieces as pieces
from tillroll.llm.oracle import FILTER_AUDIT
from tillroll.llm.tokens import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

# --- pieces

MODEL = Path(tokenizer_path(pieces.PIECE_BPE)).read_bytes()
ODD = "ab e▁ \n\t  é漢字ﬁ①́ 　ａ\U0001f600.,'<s>0​﻿¨ﷺ\x00"


def odd_text(rng, n=30):
    return "".join(rng.choice(ODD) for _ in range(rng.randrange(n)))


def library_pieces(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def own_pieces(encoder, text):
    found = encoder.encode_many([text])[0]
    return list(zip(found.ids.tolist(), found.begins.tolist(), found.ends.tolist()))


def with_map(rule, dummy_prefix, squeeze):
    """The model with another character map and other treatment of blanks."""
    message = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = next(v for f, _, v in pieces.fields(message) if f == pieces.NORMALIZER)
    compiled = next(v for f, _, v in pieces.fields(spec) if f == 2)
    spec = pieces._field(1, rule.encode()) + pieces._field(2, compiled) + bytes([0x18, dummy_prefix, 0x20, squeeze])
    kept = [(f, v) for f, _, v in pieces.fields(MODEL) if f != pieces.NORMALIZER]
    return b"".join(pieces._field(f, v) for f, v in [*kept, (pieces.NORMALIZER, spec)])


def test_pieces_and_spans_are_the_librarys():
    rng = random.Random(11)
    encoder, library = pieces.PieceEncoder.of_model(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = [odd_text(rng) for _ in range(1500)] + ["", " ", "\n\n", "a" * 9000 + " b" * 9, "<0x0A>", "</s>"]
    for text in texts:
        assert own_pieces(encoder, text) == library_pieces(library, text), text
    for text, found in zip(texts, encoder.encode_many(texts)):
        assert encoder.decode(found.ids) == library.decode(library.encode(text))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("dummy_prefix", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_compiled_maps(rule, dummy_prefix, squeeze):
    model, rng = with_map(rule, dummy_prefix, squeeze), random.Random(12)
    encoder, library = pieces.PieceEncoder.of_model(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in [odd_text(rng) for _ in range(400)] + ["", "   ", "​", " ​ "]:
        assert own_pieces(encoder, text) == library_pieces(library, text), text


def test_longest_rule_is_taken_at_each_place():
    model = with_map("nmt_nfkc", 1, 1)
    found = pieces.PieceEncoder.of_model(model).map
    text = "é ﬁx"  # a combining accent joins its letter; a ligature becomes two letters
    data, origin = found.normalise(text.encode())
    assert data.decode() == "▁é▁fix"
    assert origin.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 4, 7, 8]


def test_very_long_words_are_cut_where_no_piece_reaches(monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 8)
    rng = random.Random(13)
    encoder, library = pieces.PieceEncoder.of_model(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for _ in range(500):
        text = "".join(rng.choice("abcétheQz漢0.") for _ in range(rng.randrange(200)))
        assert own_pieces(encoder, text) == library_pieces(library, text), text
    assert len(encoder._cut("漢" * 40)) > 1


@pytest.mark.parametrize("letter", [" ", "a", "\n", "é", "漢"])
def test_a_long_run(letter):
    encoder = pieces.encoder(tokenizer_path(pieces.PIECE_BPE))
    ids = encoder.encode_many([letter * 200_000])[0].ids
    assert ids.tolist() == encoder.library.encode(letter * 200_000)


def test_word_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    encoder = pieces.PieceEncoder.of_model(MODEL)
    texts = [words(random.Random(i), 40) for i in range(6)]
    for text in texts:
        assert encoder.encode_many([text])[0].ids.tolist() == encoder.library.encode(text)
    assert len(encoder.words) <= 45


def test_unfit_models_are_refused():
    unigram = b"".join(
        pieces._field(f, v if f != pieces.TRAINER else b"") for f, _, v in pieces.fields(MODEL)
    )
    with pytest.raises(ValueError):
        pieces.PieceEncoder.of_model(unigram)


def test_piece_rows(spark):
    docs = documents(spark, awkward())
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rows, spans = [], []
    for d, t in awkward():
        ids = library.encode(t or "")
        found = library_pieces(library, t or "")
        rows.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
        spans.append(([b for _, b, _ in found], [e for _, _, e in found]))
    hashed = spark.createDataFrame(spans, "begins array<int>, ends array<int>").selectExpr("xxhash64(begins, ends) AS h")
    expected = Counter((*row, h.h) for row, h in zip(rows, hashed.collect()))
    got = pieces.sentencepiece_query(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_hash"]
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert pieces.sentencepiece_query(docs.limit(0)).count() == 0
    encoded = pieces.encode_documents(docs)
    back = Counter((r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect())
    assert back == Counter((r.doc_id, r.decoded) for r in encoded.collect())
    none = encoded.selectExpr("doc_id", "cast(NULL AS array<int>) AS ids").limit(1)
    assert [r.text for r in pieces.decode_documents(none).collect()] == [""]


# --- filter audit


def test_sorted_lists():
    rng = random.Random(14)
    for _ in range(1500):
        lists = [sorted(rng.sample(range(70), rng.randrange(50))) for _ in range(rng.randrange(1, 6))]
        assert audit.union(lists) == sorted(set().union(*lists))
        assert audit.minus(lists[0], lists[1:]) == sorted(set(lists[0]) - set().union(*lists[1:]))
        assert audit.common(lists[0], lists[-1]) == sorted(set(lists[0]) & set(lists[-1]))
        start = rng.randrange(5)
        place = audit.gallop(lists[0], rng.randrange(75), start)
        assert start <= place <= max(start, len(lists[0]))


def test_runs_are_jumped():
    """A run of one list costs a logarithm of its length, not its length."""

    class Counting(list):
        reads = 0

        def __getitem__(self, i):
            if not isinstance(i, slice):
                Counting.reads += 1
            return super().__getitem__(i)

    long, other = Counting(range(100_000)), [99_999]
    assert audit.gallop(long, 99_999, 0) == 99_999 and Counting.reads < 60
    assert len(audit.union([long, other])) == 100_000


def brute_audit(rows, labels):
    """The report from its definition, one order and document at a time."""
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1} for i in (0, 1))
    docs = []
    for i, (d, g, t) in enumerate(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * any(d is not None and e is not None and e < d and (u or "") == t for e, _, u in rows)
        docs.append((i, g or "", fails, d is not None and d in good, d is not None and d in toxic))
    out, shapley = {}, Counter()
    for part in {x[1] for x in docs}:
        mine = [x for x in docs if x[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(f in x[2] for x in mine) - len(gone), sum(x[2] == f for x in mine),
                    sum(x[3] for x in gone), sum(x[4] for x in gone),
                )
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(seed, n=150):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([5, 120, 130]), rng.choice([40, 4000])) for _ in range(n // 3)]
    texts += [t + rng.choice([" A#B", " TITLE" * 60, ""]) for t in texts] + [None, "", " \n", "É" * 300, "x&y"]
    rows = [(rng.choice([None, *range(n)]), rng.choice(["en", "en", "de", None, ""]), rng.choice(texts)) for _ in range(n)]
    rows += [(7, "en", texts[0])] * 40 + [(None, "de", texts[0])] * 40  # a hot row, with and without an id
    labels = [(rng.choice([None, *range(n)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(n)]
    return rows, labels


@pytest.mark.parametrize("block", [7, audit.BLOCK])
def test_audit_by_definition(spark, block):
    rows, labels = audit_rows(15)
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, lang string, text string, part string, n int")
    marked = spark.createDataFrame([(*r, "y") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    posted = audit.post_documents(docs.repartition(5), marked)
    ranged = posted.repartitionByRange(4, "part", "doc_id", "tie").sortWithinPartitions("part", "doc_id", "tie")
    sizes = audit.posting_sizes(ranged, block=block)
    assert sizes.count() == 80 * 3 and sizes.where("removed > n OR united < removed").count() == 0
    got = audit.audit_query(docs, marked)
    expected = brute_audit(rows, labels)
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
    total = {(r.part, r.filter, r.before): r.removed for r in sizes.collect()}
    for part, order, step, _, removed, *_ in expected:
        before = sum(1 << "ABCDE".index(f) for f in order[: step - 1])
        assert total[part, "ABCDE".index(order[step - 1]), before] == removed
    assert audit.audit_query(docs.limit(0), marked).count() == 0
    unlabelled = audit.audit_query(docs, marked.limit(0))
    assert unlabelled.where("good_lost > 0 OR toxic_lost > 0").count() == 0 and unlabelled.count() == got.count()


@needs_data
def test_audit_by_sql(spark):
    con = duckdb.connect()
    tables = {t: f"{SF_DIR}/{t}.parquet" for t in ("documents", "labels")}
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    got = audit.audit_query(*(spark.read.parquet(p) for p in tables.values()))
    assert difference(got, con, FILTER_AUDIT) is None


# --- conversations


def fault_of(rows, i):
    text = rows[i][1].strip(" \t\n\x0b\x0c\r")
    if not text:
        return "blank"
    if rows[i] in rows[:i]:
        return "duplicate"
    return "" if text[-1] in ".!?" else "truncated"


def brute_repair(rows):
    """The cheapest and then ASCII-least edits of (role, text) rows, by trying all."""
    faults = [fault_of(rows, i) for i in range(len(rows))]
    best = None

    def go(i, roles, cost, edits, out, inserts):
        nonlocal best
        if best and cost > best[0] or not re.fullmatch(r"(s?((ua)*u?)?)", roles):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles) and (not best or (cost, edits) < best[:2]):
            best = (cost, edits, out)
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, roles, cost + 3, edits + "D", out, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                go(i + 1, roles + (role[:1] or "x"), cost + more, edits + "K", [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    go(i + 1, roles + r[0], cost + 2 + more, edits + "R", [*out, (r, text)], 0)
        if inserts < 3:
            for r in ("user", "assistant"):
                go(i, roles + r[0], cost + 2, edits + "I", [*out, (r, "")], inserts + 1)

    go(0, "", 0, "", [], 0)
    return best, Counter(faults)


def test_cheapest_edits():
    rng = random.Random(16)
    for _ in range(1500):
        rows = [
            (rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " ", ""]),
             rng.choice(["Yes.", "no", " \t", "Ah! ", "b"]))
            for _ in range(rng.randrange(6))
        ]
        found = conv.Conversation(rng.choice([1, 2, 100]))
        for i, row in enumerate(rows):
            found.add(i, *row)
        gaps, blank, duplicate, truncated, illegal, cost, edits, digest = found.result()
        (least, letters, out), faults = brute_repair(rows)
        assert (cost, edits, digest) == (least, letters, sha("\n".join(f"{r}:{t}" for r, t in out))), rows
        assert (gaps, blank, duplicate, truncated) == (0, faults["blank"], faults["duplicate"], faults["truncated"])
        firsts = [r[:1] for r, _ in rows]
        assert illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))


def test_a_spilled_conversation_is_repaired_alike():
    rng = random.Random(17)
    rows = [(rng.choice(["user", "assistant", "system"]), f"text {rng.randrange(3000)}" + rng.choice([".", ""])) for _ in range(5000)]
    results = []
    for spill in (7, 1000, 1 << 18):
        found = conv.Conversation(spill)
        for i, row in enumerate(rows):
            found.add(2 * i, *row)
        results.append(found.result())
        assert (found.pointers.file is not None) == (spill < 5000)
    assert results[0] == results[1] == results[2]
    assert results[0][0] == 4999 and results[0][2] == sum(fault_of_set(rows))
    assert len(re.sub("I", "", results[0][6])) == 5000


def fault_of_set(rows):
    seen = set()
    for row in rows:
        yield row in seen
        seen.add(row)


def damaged(rows):
    """The contract's damage, one row after another: {conv_id: [(turn, role, text)]} in order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(c)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[c] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c in out:
        out[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def conversation_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(60)]:
        turn = rng.randrange(-3, 3)
        for _ in range(rng.randrange(1, 8)):
            turn += rng.choice([1, 1, 1, 2, 0])
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", None, "tool"]),
                         rng.choice(["Well. ", "no", None, "", "\n", "É!", "so?\x0b"])))
    rows += rows[5:9]  # repeated rows
    lost = next(i for i in range(100, 10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "All of it is dropped.")], lost


def test_conversation_rows(spark):
    rows, lost = conversation_rows(18)
    schema = "conv_id bigint, turn bigint, role string, text string, copies string, audit int, _rows int"
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    got = {r.conv_id: r for r in conv.conversation_query(frame.repartition(7)).collect()}
    expected = damaged(rows)
    assert got.keys() == {r[0] for r in rows} and conv.conversation_query(frame).count() == len(got)
    for c, mine in expected.items():
        best, faults = brute_repair([r[1:] for r in mine])
        turns = [t for t, *_ in mine if t is not None]
        r = got[c]
        assert (r.cost, r.audit) == best[:2], mine
        assert r.repaired_sha256 == sha("\n".join(f"{a}:{b}" for a, b in best[2]))
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults[f] for f in ("blank", "duplicate", "truncated"))
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    assert tuple(got[lost])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert conv.conversation_query(frame.limit(0)).count() == 0

    damage = conv.damage(frame)
    repaired = conv.repaired_rows(damage, conv.repair_conversations(damage, "copies"), "copies").collect()
    by = defaultdict(list)
    for r in sorted(repaired, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position)):
        assert r.position == len(by[r.conv_id])
        by[r.conv_id].append(r)
    for c, r in got.items():
        assert sha("\n".join(f"{x.role}:{x.text}" for x in by[c])) == r.repaired_sha256
        assert "".join(x.edit for x in by[c]) == r.audit.replace("D", "")
    plain = conv.repair_conversations(frame)
    assert plain.count() == len({r[0] for r in rows})


def test_a_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(c, t, ("user", "assistant", "user")[t % 3], f"{c} {t}.") for c in (1, 2) for t in range(50)]
        frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        got = {r.conv_id: r for r in conv.repair_conversations(frame, spill=4).collect()}
        for c in (1, 2):
            one = conv.Conversation(1000)
            for _, t, role, text in rows[50 * (c - 1) : 50 * c]:
                one.add(t, role, text)
            assert tuple(got[c])[1:] == one.result()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
