"""Operators 11 to 13 against plain versions on small tables."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from varve.llm import alignment, importance, packing, tokens
from varve.llm.kernels import distinct_words, spans, words

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = [
    (9001, None),
    (9002, ""),
    (9003, "a▁b"),
    (9004, "日本語 テキスト 🎉🎉 naïve\x00 \x1c x"),
    (9005, "  two  spaces \n\n x"),
    (9006, "<|endoftext|> it's </s> <|startoftext|>x a<|endoftext|>b <0x41>"),
    (9007, "=" * 500),
    (9008, "ｆｕｌｌ ｗｉｄｔｈ İstanbul ΣΑΣ ǅ ﬁ"),
    (9009, "한국어 조선 Ελλάδα ПРИВЕТ É É don't DON'T I'LL 123 4a5"),
    (9010, "x y z\u0085w ​ q"),
    (None, "no id at all"),
    (1, "twice the same row"),
    (1, "twice the same row"),
]


def corpus(spark, n=60):
    rng = np.random.default_rng(5)
    stock = ["".join(rng.choice(list("abcdeinorst"), rng.integers(1, 9))) for _ in range(300)]
    texts = [(k, " ".join(rng.choice(stock, rng.integers(0, 200))).capitalize() + ". É " + stock[k % 7].upper()) for k in range(2, n)]
    texts.append((n, " ".join(rng.choice(stock, 9000))))
    rows = texts + ODD
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("ids", "score", "weight", "block", "c0", "n_words", "first", "pair")})


# ---- op11


def plain_features(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_ranks(rows, target, percent=5):
    count = lambda ts: Counter(zlib.crc32(f.encode()) % 10000 for t in ts for f in plain_features(t)[1])
    s, t = count([r[1] for r in rows]), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    out = []
    for doc_id, text in rows:
        w, f = plain_features(text)
        weight = sum(gain(zlib.crc32(x.encode()) % 10000) for x in f)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20])
    best = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(best[: percent * len(best) // 100]):
        r.append(k + 1)
    return sorted([tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in out], key=str)


@pytest.mark.parametrize("nodes, percent", [(1 << 21, 5), (50, 60)])
def test_importance_equals_plain_version(spark, monkeypatch, nodes, percent):
    monkeypatch.setattr(importance, "NODES", nodes)
    monkeypatch.setattr(importance, "PIECE", 64 if nodes == 50 else 1 << 19)
    rows, docs = corpus(spark)
    target = [rows[3][1], "wholly other words of a target", None]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.ranked(docs, importance.target_gains(docs, bench), percent).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_ranks(rows, target, percent)


def test_resampled_keeps_columns_and_drawn_rows(spark):
    rows, docs = corpus(spark)
    docs = docs.withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    out = importance.resampled(docs, bench, 20)
    assert out.columns == docs.columns
    ranks = importance.ranked(docs, importance.target_gains(docs, bench), 20).filter("rank IS NOT NULL")
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in ranks.collect())
    none = docs.limit(0)
    assert importance.ranked(none, importance.target_gains(none, bench)).count() == 0
    assert importance.resampled(none, bench).count() == 0
    # an empty target counts zero in every bucket
    assert importance.ranked(docs, importance.target_gains(docs, bench.limit(0))).count() == len(rows)


def test_crc_of_joined_strings():
    parts = [(b"", b"x"), (b"abc", b" " * 1000), ("é".encode(), b" word"), (b"a" * 70000, b"b" * 70001)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = importance.crc_after(crc([a for a, _ in parts]), crc([b for _, b in parts]), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_trie_holds_each_run_once():
    trie = importance.WordTrie()
    buf = np.frombuffer(b"a b a b a c", np.uint8)
    starts, ends, first = words(buf, np.array([0, len(buf)]), importance._INNER)
    found, which = distinct_words(buf, starts, ends)
    trie.walk(trie.intern(found.to_pylist())[which], first[-1] - np.arange(len(which)), len(which))
    assert [len(x.crc) for x in trie.levels] == [3, 3, 3]
    assert [sorted(x.count.tolist()) for x in trie.levels] == [[1, 2, 3], [1, 2, 2], [1, 1, 2]]
    assert trie.totals().sum() == 6 + 5 + 4


# ---- tokenizers


def test_encoders_return_the_ids_of_the_tokenizers(spark):
    rows, _ = corpus(spark)
    texts = [t or "" for _, t in rows]
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    ids, first = tokens.WordTable(tokens.word_encoder(WORD)).encode(buf, offsets)
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == word.encode(t, add_special_tokens=False).ids, t
        assert tokens.byte_encoder(BYTE).encode(t) == byte.encode(t, add_special_tokens=False).ids, t


def test_tasks_of_a_process_encode_a_word_once(monkeypatch):
    asked, encode = [], tokens.WordEncoder.encode
    monkeypatch.setattr(tokens.WordEncoder, "encode", lambda self, found: asked.extend(found) or encode(self, found))
    tokens.word_table(WORD).clear()
    for text in (b"one two three", b"three two four one"):
        buf = np.frombuffer(text, np.uint8)
        ids, _ = tokens.word_table(WORD).encode(buf, np.array([0, len(text)]))
        assert ids.tolist() == Tokenizer.from_file(WORD).encode(text.decode(), add_special_tokens=False).ids
    assert asked == [b"one", b"two", b"three", b"four"]


def test_every_vocabulary_entry_encodes_to_itself():
    """What makes merging by rank the same as merging by the merge list."""
    word, byte = tokens.word_encoder(WORD), tokens.byte_encoder(BYTE)
    for k, p in enumerate(byte.pieces):
        if p:
            assert byte.ranks.encode_single_token(p) == k
    letters = {v: c for c, v in tokens.byte_letters().items()}
    merged = byte.tokenizer.model
    for k in range(0, len(byte.pieces), 7):
        p = byte.pieces[k]
        if p:
            assert [t.id for t in merged.tokenize("".join(letters[b] for b in p))] == [k]
    vocab = word.tokenizer.get_vocab(with_added_tokens=False)
    for entry, k in vocab.items():
        if entry.endswith("</w>") and entry not in word.special:
            assert [t.id for t in word.tokenizer.model.tokenize(entry[:-4])] == [k], entry


def test_plain_characters_fold_as_the_tokenizer_folds_them():
    encoder = tokens.word_encoder(WORD)
    plain = [c for c in map(chr, range(0x21, 0xD800)) if not tokens._ODD.search(c)]
    assert len(plain) > 30000
    for c in plain:
        text = f"a{c}b"
        assert encoder.tokenizer.normalizer.normalize_str(text) == unicodedata.normalize("NFC", text).lower(), hex(ord(c))


def test_word_table_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 3)
    table, plain = tokens.WordTable(tokens.word_encoder(WORD)), Tokenizer.from_file(WORD)
    for text in ("one two three four five", "six one two", "four", ""):
        raw = text.encode()
        ids, first = table.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and first.tolist() == [0, len(ids)]


# ---- op12


def check_packing(got, rows, window):
    encoder = Tokenizer.from_file(WORD)
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, tuple(encoder.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (doc_id, ids), times in want.items():
        pieces = [r for r in by_doc[doc_id] if r.doc_tokens == len(ids)]
        covered = Counter()
        for r in pieces:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            covered.update(range(r.start, r.start + r.length))
        assert covered == {k: times for k in range(len(ids))}
    sizes = []
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        sizes.append(at)
    assert all(n & (n - 1) == 0 for n in sizes)
    assert sum(sizes) == sum(len(ids) * n for (_, ids), n in want.items())


@pytest.mark.parametrize("window, shard", [(4096, 1024), (64, 8), (4096, 3)])
def test_packing_places_every_id_once(spark, window, shard):
    rows, docs = corpus(spark)
    got = packing.packed(docs, WORD, window=window, shard=shard).collect()
    check_packing(got, rows, window)


def test_packing_of_nothing_and_of_equal_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(docs, WORD).count() == 0
    same = [(k, "one text that all of them hold " * 30) for k in range(500)]
    check_packing(packing.packed(spark.createDataFrame(same, "doc_id long, text string").repartition(3), WORD, shard=64).collect(), same, 4096)


def test_sequences_hold_their_ids(spark):
    rows, docs = corpus(spark)
    encoder = Tokenizer.from_file(WORD)
    got = packing.sequences(docs, WORD, window=256).collect()
    assert sorted(x for r in got for x in r.ids) == sorted(x for _, t in rows for x in encoder.encode(t or "", add_special_tokens=False).ids + [2])
    assert all(r.length == len(r.ids) <= 256 for r in got)


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, rng.integers(1, 40)) for _ in range(30)]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    idf, mean = packing.inverse_frequency(held, 30), float(np.mean([len(d) for d in docs]))
    index = packing.ShardIndex(docs, idf, mean)
    for seed in (0, 7, 29):
        plain = []
        for d in docs:
            tf = Counter(d.tolist())
            norm = 1.2 * (1 - 0.75 + 0.75 * len(d) / mean)
            plain.append(sum(math.log(1 + (30 - held[t] + 0.5) / (held[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + norm) for t in set(docs[seed].tolist()) if tf[t]))
        assert np.allclose(index.scores(seed), plain)


def test_windows_hold_documents_of_one_topic():
    """Two topics without a common word, mixed in order: a window seeded by one is filled with it while there is any."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(100 * (k % 2), 100 * (k % 2) + 100, 50) for k in range(40)]
    got = list(packing.sequences_of(docs, np.ones(200), 50.0, window=256))
    mixed = [len({k % 2 for k, _, _ in pieces}) > 1 for pieces in got]
    assert sum(mixed) <= 1


# ---- op13


def plain_alignment(rows):
    first = Tokenizer.from_file(BYTE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letters = tokens.byte_letters()
    found, held = [], Counter()
    for doc_id, text in rows:
        raw = f" {text}".encode()
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(f" {text}", add_special_tokens=False).ids] if text else []
        pieces = [(i, second.id_to_piece(i)) for i in second.encode(text)] if text else []
        b = [(i, bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append((doc_id, [], [], []))
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        groups, lo = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([i for (i, _), e in zip(side, es) if lo < e <= cut] for side, es in zip((a, b), ends)))
            lo = cut
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        found.append((doc_id, groups, [i for i, _ in a], [i for i, _ in b], links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc_id, groups, a, b, *links in found:
        links = links[0] if links else []
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), digest, sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, links", [(1 << 22, 1 << 21), (500, 40)])
def test_alignment_equals_plain_version(spark, monkeypatch, block, links):
    monkeypatch.setattr(alignment.link_pieces, "__defaults__", (links,))
    rows, docs = corpus(spark, 30)
    got = alignment.aligned(docs, BYTE, PIECE, block)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_alignment(rows)


def test_alignment_of_nothing_and_groups(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(none, BYTE, PIECE).count() == 0
    rows, docs = corpus(spark, 10)
    byte = Tokenizer.from_file(BYTE)
    got = alignment.groups(docs.filter("doc_id BETWEEN 2 AND 9"), BYTE, PIECE).orderBy("doc_id", "place").collect()
    for doc_id, text in rows:
        if doc_id is not None and 2 <= doc_id <= 9:
            own = [r for r in got if r.doc_id == doc_id]
            assert [r.place for r in own] == list(range(len(own)))
            assert [x for r in own for x in r.a] == byte.encode(f" {text}", add_special_tokens=False).ids


def test_ranks_and_cuts_of_packed_sets():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(rng.integers(1, n + 1, n // 3), n)) for _ in range(2))
        x, y = alignment.Marks(a, n), alignment.Marks(b, n)
        cuts = alignment.shared_cuts(x, y)
        assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert x.rank(cuts).tolist() == [int((a <= c).sum()) for c in cuts]


def test_a_group_of_many_tokens_on_both_sides_is_linked_in_parts():
    s = alignment.Slice(np.arange(40) % 7, np.arange(30) % 5, np.array([40]), np.array([30]), np.array([0]))
    whole = {(p, n) for _, p, n in zip(*alignment.links(s, 10))}
    parts = [x for piece in alignment.link_pieces(s, 10, 12) for x in zip(*piece)]
    assert {(p, n) for _, p, n in parts} == whole
    assert sum(n for _, n in whole) == 40 * 30


def test_spans():
    assert spans(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert spans(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
