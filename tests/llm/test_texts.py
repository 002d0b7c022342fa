"""Operators on texts against plain versions, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from riskcohort.llm import components, induced, merkle, packing, simhash, suffix_dedup, token_counts, windows

PATH = token_counts.word_tokenizer_path()
SEP = re.compile(rb"[^\x20\x09-\x0D]+")


def token_ids(text):
    return token_counts.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("frequent", [1, 50, 1 << 18])
def test_token_counts(docs, texts, frequent):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, PATH, frequent=frequent).collect()}
    assert got == {i: (len((t or "").encode()), len(token_ids(t))) for i, t in texts}


def test_token_counts_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(odd_docs, PATH).collect())
    assert got == [(-1, 0), (-1, 3), (5, 3), (5, 3), (6, 1), (6, 2)]
    assert token_counts.token_counts(no_docs, PATH).count() == 0


def test_word_encoder_equals_the_tokenizer():
    rng = np.random.default_rng(3)
    alphabet = list("aBÉß ªº²½'sStT١Ωσς中İıſ_-<|>%…\u0085ŉ")
    words = ["".join(rng.choice(alphabet, 6)).replace(" ", "") or "x" for _ in range(3000)]
    words += ["<|endoftext|>", "a<|endoftext|>b", "don't", "DON'T'S", "plain", "Été"]
    encoder = token_counts.WordEncoder(PATH)
    assert encoder.split and encoder.ids(words) == encoder._library(words)
    plain = [w for w in words if token_counts._PLAIN.fullmatch(w) and "<|" not in w]
    assert encoder.ids(plain) == encoder._library(plain)


def test_merkle_pairs(docs, texts):
    got = {r.doc_id: r for r in merkle.edited_neighbours(docs).collect()}
    plain = [t or "" for _, t in texts]
    for k, (i, t) in enumerate(texts):
        t, following, r = t or "", plain[(k + 1) % len(plain)], got[i]
        edited = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == merkle.tree(t.encode())[0] and r.edited_fingerprint == merkle.tree(edited.encode())[0]
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (edited == t)
        for s, e in r.edits:  # what is not in these ranges is in the first text
            assert e <= len(edited.encode())


def test_merkle_tree_locates_an_edit():
    lines = [f"line {i} of a text that is long enough to have pieces, with number {i * 7919 % 1000}\n" for i in range(200)]
    a = "".join(lines).encode()
    lines[120] = "something else entirely\n"
    b = "".join(lines).encode()
    at = b.index(b"something")
    spans = merkle.changed(merkle.tree(a)[0], merkle.tree(b)[0])
    assert any(s <= at < e for s, e in spans) and sum(e - s for s, e in spans) < 400
    assert merkle.changed(merkle.tree(a)[0], merkle.tree(a)[0]) == []
    assert 0.9 < merkle.likeness(merkle.tree(a)[1], merkle.tree(b)[1]) < 1
    assert merkle.parse(merkle.tree(a)[0]) == merkle.tree(a)[1]


def test_merkle_odd_rows(odd_docs, no_docs, spark):
    assert merkle.edited_neighbours(odd_docs).count() == 6
    assert merkle.edited_neighbours(no_docs).count() == 0 and merkle.fingerprints(no_docs).count() == 0
    one = merkle.edited_neighbours(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1


def plain_fingerprint(text, words=3):
    w = SEP.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + words]), seed=42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum((h >> k) & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, texts):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts}
    assert {i: fp % (1 << 64) for i, (fp, _) in got.items()} == prints
    component = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            component[i] = min(component[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
    assert {i: c for i, (_, c) in got.items()} == component


def test_simhash_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == [(-1, -1), (-1, -1), (5, 5), (5, 5), (6, 6), (6, 6)]
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("crowd", [False, True])
def test_links_in_a_cell_connect_what_links(crowd):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 6)).astype(np.uint64), axis=0)
                                  for _ in range(40)]))
    pairs = (simhash._crowd_stars if crowd else simhash._stars)(x, 3)
    part = list(range(len(x)))
    for i, j in pairs:
        a, b = part[i], part[j]
        part = [a if p == b else p for p in part]
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = np.arange(len(x))
    for _ in x:
        want = np.array([want[near[i]].min() for i in range(len(x))])
    assert len(set(part)) == len(set(want)) == len(set(zip(part, want.tolist())))


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 1 << 64, (2, 5000), dtype=np.uint64)
    pairs = lambda v: np.stack([np.bitwise_count((v >> np.uint64(k)) & np.uint64(3)) for k in range(0, 64, 2)]).astype(int)
    manhattan = np.abs(pairs(x) - pairs(y)).sum(axis=0)
    assert (np.bitwise_count(simhash._embedded(x) ^ simhash._embedded(y)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(x ^ y)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def plain_windows(texts, width):
    words = [SEP.findall((t or "").encode()) for t in texts]
    count = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        yield len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()


@pytest.mark.parametrize("width,buckets", [(35, None), (3, 7), (1, 2)])
def test_repeated_windows(docs, texts, width, buckets):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in windows.remove_repeated(docs, width=width, buckets=buckets).collect()}
    assert got == dict(zip([i for i, _ in texts], plain_windows([t for _, t in texts], width)))


def test_repeated_windows_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id or -1, r.n_removed) for r in windows.remove_repeated(odd_docs, width=2).collect())
    assert got == [(-1, 0), (-1, 0), (5, 3), (5, 3), (6, 0), (6, 0)]
    assert windows.remove_repeated(no_docs).count() == 0


def plain_repeats(texts, length):
    seen = set()
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(b[i:i + length])
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        yield len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)


@pytest.mark.parametrize("length,gram", [(100, 40), (20, 8)])
def test_repeated_strings(docs, texts, length, gram):
    found = suffix_dedup.remove_repeats(docs, length=length, gram=gram).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found}
    assert got == dict(zip([i for i, _ in texts], plain_repeats([t for _, t in texts], length)))
    assert all(sum(e - s for s, e in r.spans) == r.n_removed for r in found)


def test_repeated_strings_odd_rows(odd_docs, no_docs):
    found = suffix_dedup.remove_repeats(odd_docs, length=8, gram=4).collect()
    assert len(found) == 6 and sum(r.n_removed for r in found) == 0  # rows that repeat are one text
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("memory", [0, 1 << 20])
def test_induced_sorting(memory):
    rng = np.random.default_rng(1)
    for _ in range(150):
        depth = int(rng.choice([3, 10, 100]))
        text = rng.choice(list(b"ab\xff\x00")[:rng.integers(1, 5)], rng.integers(1, 80)).astype(np.uint8)
        data = text.tobytes()
        blocks = list(induced.suffixes(text, depth, memory))
        order, shared = (np.concatenate([b[i] for b in blocks])[::-1] for i in (0, 1))
        keys = [data[i:i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(data))) and keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], shared):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_packing(docs, texts):
    rows = packing.pack(docs, PATH).collect()
    ids = {i: np.array([*token_ids(t), 2], "<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[i][at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padded += at & (at - 1) != 0
    assert padded <= 1


def test_packing_odd_rows(odd_docs, no_docs):
    assert sum(r.length for r in packing.pack(odd_docs, PATH, window=8).collect()) == 3 + 3 + 3 + 1 + 2 + 0 + 6
    assert packing.pack(no_docs, PATH).count() == 0


def test_plan_places_a_shared_length():
    counts = np.zeros(4096, np.int64)
    counts[3000], counts[1096], counts[100] = 1000, 400, 5
    slots, taken, sequences = packing.plan(counts, 4096)
    assert sequences >= 400 and taken[3000] >= 400 and (taken <= counts).all()


def test_packed_ids_are_those_of_the_whole_text():
    """Across groups of texts, with words known from before; a slice of a column, nulls and odd white space."""
    texts = ["skip", "The end. the END, <|endoftext|> 中文 ça", None, "", " \t\x0b\x0c\r\n", "\x1c a\x1db\x85c ",
             " the end ", "x" * 3000, "end the."] * 2
    ids, whole = packing.WordIds(PATH, bound=4), token_counts.tokenizer(PATH)
    column = pa.array(texts).slice(1)
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts[1:]]
    assert list(ids.of(column)) == want
    assert list(ids.of(column)) == want and ids.older
    words = ["The", "end.", "中文", "<|endoftext|>", "ça", "the"]
    encoder = token_counts.WordEncoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.packed(words)] == encoder.ids(words)
    assert {"the", "end", "."} <= encoder.parts.keys() and encoder.packed([]) == []


@pytest.mark.parametrize("most", [0, packing.CUT_ROWS])
def test_cut_documents_are_packed_alike(docs, odd_docs, texts, monkeypatch, most):
    """Pieces of cut documents meet their texts by a broadcast or by a shuffle."""
    monkeypatch.setattr(packing, "CUT_ROWS", most)
    rows = packing.pack(docs, PATH, window=64).collect()
    whole = token_counts.tokenizer(PATH)
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine]).tolist()[:-1]]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in mine)
        assert sum(r.length for r in mine) == len(ids)
    assert sum(r.doc_tokens == r.length for r in packing.pack(odd_docs, PATH).collect()) > 0
