"""Decontamination, packing, token counts and suffix dedup against brute force, and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest_llm import docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwin.llm import decontaminate, packing, queries, suffix_dedup, token_counts
from braidwin.llm.common import table

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + window]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out[doc] = (len(w), len(hit), sorted(map(str, found)))
    return out


def made_of_few_words(rng, n):
    return " ".join(["Alpha", "beta,", "GAMMA", "é1", "x-y"][i] for i in rng.integers(0, 5, n))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(1)
    items = [(i, made_of_few_words(rng, int(n))) for i, n in enumerate([1, 3, 12, 13, 14, 20, 0, 30])] + [(99, None), (3, "zeta eta theta"), (100, "x-y")]
    docs = [(i, made_of_few_words(rng, int(n))) for i, n in enumerate(rng.integers(0, 60, 40))] + [(50, "Zeta, eta; THETA! end"), (51, None), (52, "\x7f{|}~")]
    docs += [(60, "head " + items[5][1] + " tail")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs_frame(spark, docs), benchmark, block_bytes=block_bytes).collect()}
    for doc, (n, hit, ids) in hits(docs, items).items():
        r = found[doc]
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, hit, ids), doc
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert found[60].longest_match >= 20 and found[51].longest_match == 0


def test_blocks_find_the_same_longest_match(spark, monkeypatch):
    common = " ".join(f"w{i}" for i in range(13))
    items = [(i, f"{common} tail{i}") for i in range(30)] + [(None, common + " none"), (77, "two words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, [(1, f"head {common} end"), (2, f"{common} tail7 x {common} tail21"), (3, f"{common} none"), (4, "two words"), (5, "no hit")])
    events, search, write = [], decontaminate._matches, decontaminate.written
    monkeypatch.setattr(decontaminate, "_matches", lambda *a: events.append("search") or search(*a))
    monkeypatch.setattr(decontaminate, "written", lambda *a: events.append("written") or write(*a))
    one, many = ({r.doc_id: (r.longest_match, r.longest_start, r.longest_item, r["items"]) for r in decontaminate.contamination(docs, benchmark, block_bytes=b).collect()} for b in (1 << 20, 300))
    assert one == many and one[2][:3] == (14, 0, "7")
    # The block alone, then each block searched and written before the next, then the pass that counts words.
    assert events[0] == events[-1] == "search" and len(events) > 8 and events[1:-1] == ["search", "written"] * ((len(events) - 2) // 2)


def test_decontamination_of_odd_rows_and_empty_tables(spark, odd):
    benchmark = spark.createDataFrame([(1, "one"), (None, "two words"), (2, None)], "item_id long, text string")
    out = decontaminate.contamination(odd, benchmark)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns.count("items") == 1
    assert sorted((r.text, r.n_hit, tuple(r["items"])) for r in rows if r.n_hit) == [("one", 1, ("1",))] * 3 + [("two words", 2, ())]
    assert decontaminate.contamination(odd.limit(0), benchmark).count() == 0
    assert decontaminate.contamination(odd, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_packing_keeps_every_token_once(spark, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"Word{int(x)}s, don't!" for x in rng.integers(0, 500, int(n)))) for i, n in enumerate(rng.integers(0, 900, 150))]
    frame = docs_frame(spark, docs).unionByName(odd)
    packed = packing.pack(frame, window=1024, with_ids=True).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    full = packed.groupby("sequence_id")["length"].sum()
    assert full.sum() / (1024 * len(full)) > 0.97
    packed = packed.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id")["length"].cumsum() - packed["length"] == packed["offset"]).all()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in packed.itertuples())
    for i, text in docs + [(5, odd.where("doc_id = 5").first().text), (6, odd.where("doc_id = 6").first().text)]:
        mine = packed[(packed.doc_id == i) & (packed.doc_tokens > 1) & (packed.source.notna())]
        mine = mine[mine.n_chars == len(text)].sort_values("start")
        if text:
            assert np.concatenate(mine["ids"].tolist()).tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]
    assert (packed[packed.doc_id.isin([2, 3])]["length"] >= 1).all()
    assert len(packed[(packed.doc_id == 4) & (packed.n_chars == 3)]) == 2  # rows that repeat are packed each
    assert packing.pack(frame.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(100, 150))
def test_differencing_stays_within_capacity(sizes, window):
    sizes = np.array(sizes)
    at = packing.assign(sizes, window)
    loads = np.bincount(at, weights=sizes)
    assert loads.max() <= window and len(at) == len(sizes)


def test_differencing_of_halves():
    at = packing.assign(np.full(400, 2100), 4096)
    assert np.bincount(at).max() == 1
    assert packing.assign(np.zeros(0, np.int64), 10).tolist() == []


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1000, 500)
    loads = np.bincount(packing.difference(sizes, 20), weights=sizes, minlength=20)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() < 20


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["Word", "don't", "WE'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "É", "e\u0301", " ", "\n", ".,", "12", "İ", "ẞ", "x"]), max_size=12).map("".join)), max_size=5))
def test_cached_encoding_equals_the_whole(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    found = packing.encode(packing.default_tokenizer(), [t.encode(errors="ignore") for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [own.encode(t.encode(errors="ignore").decode(), add_special_tokens=False).ids for t in texts]


def test_cached_encoding_of_odd_letters():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    rng = np.random.default_rng(6)
    marks = ["a", "é", "É", "ß", "ẞ", "İ", "ı", "Σ", "σ", "ς", "e\u0301", "\u0301", "漢", "١", "ǅ", "ﬁ", "Ω", "ª", "µ", "ʰ", "\xad", "'s", "'", ".", "!", "1", " ", "\n", "\x85", "\u3000", "\U0001d49c", "🙂", "न", "ा", "한", "\u1112", "\u1161", "Å", "K"]
    texts = ["".join(rng.choice(marks, int(n))) for n in rng.integers(1, 9, 4000)]
    found = packing.encode(packing.default_tokenizer(), [t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def allocated(text, rule):
    """Tokens of each line, one token at a time."""
    own = token_counts.encoder(token_counts.default_ranks())
    data = text.encode()
    ends = [i + 1 for i, b in enumerate(data) if b == 10]
    cuts = sorted({0, *ends, len(data)})
    out, pos = [0.0] * (len(cuts) - 1), 0
    for token in own.encode_ordinary(text):
        lo = pos
        pos = hi = pos + len(own.decode_single_token_bytes(token))
        while (data[lo] & 0xC0) == 0x80:
            lo -= 1
        while hi < len(data) and (data[hi] & 0xC0) == 0x80:
            hi += 1
        part = [max(0, min(hi, b) - max(lo, a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if rule == "share":
            out = [o + p / sum(part) for o, p in zip(out, part, strict=True)]
        else:
            out[part.index(max(part)) if rule == "majority" else next(i for i, p in enumerate(part) if p)] += 1
    return out


TEXTS = ["one line", "a\n\n\n  b\nc", "\n\n \n", "é 🙂🙂\n漢字 \n\n\n\n\n\n\n\n x", "tab\t\n\t y", "it's \n 12345 !!!\n", " \n x"]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_line(spark, odd, rule):
    docs = list(enumerate(TEXTS))
    rows = token_counts.token_counts(docs_frame(spark, docs), rule=rule).collect()
    for i, text in docs:
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        assert [r.n_tokens for r in mine] == pytest.approx(allocated(text, rule)), text
        assert "".join(text[r.char_start : r.char_end] for r in mine) == text
        assert sum(r.n_tokens for r in mine) == pytest.approx(mine[0].doc_tokens)
    out = token_counts.token_counts(odd, rule=rule).collect()
    assert sum(r.doc_id == 4 for r in out) == 3 and [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert token_counts.token_counts(odd.limit(0), rule=rule).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(odd, rule="none")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85  ab'é漢🙂1.,-"), max_size=60))
def test_cached_chunks_equal_the_whole_encoding(text):
    own = token_counts.encoder(token_counts.default_ranks()) if not hasattr(test_cached_chunks_equal_the_whole_encoding, "own") else test_cached_chunks_equal_the_whole_encoding.own
    test_cached_chunks_equal_the_whole_encoding.own = own
    whole = [len(own.decode_single_token_bytes(t)) for t in own.encode_ordinary(text)]
    assert token_counts.token_bytes(token_counts.default_ranks(), text).tolist() == whole


def starts(docs, length):
    """doc -> its starts of strings of ``length`` bytes that also stand elsewhere."""
    seen = {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], []).append(doc)
    out = dict.fromkeys((doc for doc, _ in docs), 0)
    for places in seen.values():
        for doc in places if len(places) > 1 else ():
            out[doc] += 1
    return out


def removed(docs, length, keep_first):
    """(doc, key in order of text hash is not needed: ids are unique) -> removed places."""
    seen = {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], []).append((doc, i))
    out = {doc: set() for doc, _ in docs}
    for places in seen.values():
        if len(places) > 1:
            for doc, i in sorted(places)[1:] if keep_first else places:
                out[doc].update(range(i, i + length))
    return out


@pytest.mark.parametrize("hot", [1, 1500])
@pytest.mark.parametrize("keep_first", [True, False])
def test_repeated_strings(spark, monkeypatch, hot, keep_first):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, other = text(130), text(90)
    docs = [(i, text(int(n)) + (shared if i % 3 else "") + text(20) + (other if i % 2 else "")) for i, n in enumerate(rng.integers(0, 200, 24))]
    docs += [(30, docs[1][1]), (31, docs[1][1]), (32, "ab" * 200), (33, "x" * 300), (34, shared + shared), (35, None), (36, "short"), (37, other[10:] + shared[:70])]
    frame = docs_frame(spark, docs).repartition(3)
    docs_end = [(40, "begin " + shared[:55]), (41, shared[:55])]  # at a text's end, longer than the floor and shorter than the length
    docs, frame = docs + docs_end, frame.unionByName(docs_frame(spark, docs_end))
    found = {r.doc_id: r for r in suffix_dedup.dedup(frame, length=60, keep_first=keep_first, floor=45).collect()}
    factors = starts(docs, 45)
    for doc, gone in removed(docs, 60, keep_first).items():
        data = (dict(docs)[doc] or "").encode()
        r = found[doc]
        assert {i for s in r.spans for i in range(s.lo, s.hi)} == gone, doc
        assert bytes(r.kept) == bytes(b for i, b in enumerate(data) if i not in gone)
        assert (r.n_bytes, r.n_removed) == (len(data), len(gone))
        assert all(a.hi < b.lo for a, b in zip(r.spans[:-1], r.spans[1:], strict=True))
        assert r.n_factors == factors[doc], doc


def test_the_query_equals_brute_force_over_a_whole_table(spark):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect())
    gone, factors = removed(docs, suffix_dedup.MIN, False), starts(docs, suffix_dedup.FLOOR)
    rows = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, SF).collect()}
    assert len(rows) == len(docs) and sum(map(bool, gone.values())) > 10 and any(factors[d] and not gone[d] for d, _ in docs)
    for doc, text in docs:
        data, r = text.encode(), rows[doc]
        kept = bytes(b for i, b in enumerate(data) if i not in gone[doc])
        n_spans = sum(i - 1 not in gone[doc] for i in gone[doc])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_factors) == (len(data), len(gone[doc]), n_spans, hashlib.sha256(kept).hexdigest(), factors[doc])


def test_repeats_of_odd_rows(spark, odd):
    out = suffix_dedup.dedup(odd, keep_first=False)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns.count("spans") == 1
    assert {r.doc_id: r.n_removed for r in rows if r.n_removed} == {7: 5000}
    twice = suffix_dedup.dedup(odd.where("doc_id = 5").unionByName(odd.where("doc_id = 5")), keep_first=False).collect()
    assert len(twice) == 2 and all(bytes(r.kept) == b"" for r in twice)
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0


def test_suffix_ranks():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 99, 300).astype(np.uint8)
    data = buf.tobytes()
    for length in (1, 5, 8, 13, 40):
        keys = [data[i : i + length].ljust(length, b"\0") for i in range(len(data))]
        order = {k: n for n, k in enumerate(sorted(set(keys)))}
        assert [order[k] for k in keys] == suffix_dedup.ranks(buf, length)[0].tolist()
    pair = suffix_dedup.ranks(buf, 13, 40)
    assert [x.tolist() for x in pair] == [suffix_dedup.ranks(buf, n)[0].tolist() for n in (13, 40)]
    wide = np.frombuffer(bytes(rng.integers(97, 101, (1 << 21) + 5).astype(np.uint8)), np.uint8)  # places of 22 bits: the other sort
    at = rng.integers(0, len(wide) - 9, 400)
    rank, keys = suffix_dedup.ranks(wide, 9)[0][at], [wide[i : i + 9].tobytes() for i in at]
    assert np.argsort(rank, kind="stable").tolist() == sorted(range(400), key=lambda i: keys[i])
