"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import functools
import hashlib
import math
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sleuthframe.llm import bpe, chat, components, embedding_dedup, hashing, jaccard_join, line_dedup, lm_scoring, media, packing, token_counts, toxicity

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, n_tokens string, score string, row string"


def common(words, n, seed):
    return " ".join(np.random.default_rng(seed).choice(words, n))


WORDS = [f"{a}{b}" for a in ("the", "and", "inge", "ouen", "Tion", "stre", "ñez") for b in ("", "ha", "er.", "lly", "WH", "é,")]
BASE = common(WORDS, 120, 1)
TEXTS = [
    None, "", " ", "\n\n", "short", "one two three", BASE, BASE, BASE.upper(), BASE + " more", BASE.replace("the", "th3", 1), common(WORDS, 4000, 2), "x" * 5000, "  spaces \t and\r\nlines  ",
    "日本語のテキスト 中文", "<|endoftext|> inside <|startoftext|>", "İstanbul ſtraße Ⅷ ½", "A line that many documents share, all of it\nown one", "a LINE that many documents share, all of it \nown two", "\tA line that many documents share, all of it\nown three\n",
    "emoji 👍🏽 é   \x1c end", common(WORDS, 30, 3), common(WORDS, 30, 3) + " x",
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "en", "clash", "clash", "clash"), (None, BASE, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def docs():
    return [*enumerate(TEXTS), (6, TEXTS[6]), (None, BASE)]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# Token counts.


def test_token_counts_agree_with_the_library(documents, nothing):
    library = Tokenizer.from_file(WORD)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.report(documents, WORD).collect())
    want = Counter()
    for i, t in docs():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert got == want
    assert token_counts.report(nothing, WORD).count() == 0
    kept = token_counts.token_counts(documents, WORD)
    assert set(kept.columns) == set(documents.columns) and kept.schema["n_tokens"].dataType.simpleString() == "bigint"


@functools.lru_cache
def library_of(path):
    return Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_word_counter_on_any_text(text):
    assert token_counts.counter(WORD).count(text) == len(library_of(WORD).encode(text, add_special_tokens=False).ids)


# Encoding.


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "'", "re", "'s", "\n", "é", "1", "-", "中", "<|endoftext|>", "word", "→", "ع", "🏽", "\x1c", "\x85", "™", "e\u0301", "ⅷ", "न", "\t", " "]), max_size=60))
def test_chunks_join_exactly(parts):
    text = "".join(parts)
    encoder = bpe.ChunkEncoder(bpe.vocabulary(BYTE))
    least, bits = bpe.LEAST_CHUNK, bpe.CHUNK_BITS
    bpe.LEAST_CHUNK, bpe.CHUNK_BITS = 3, 2
    try:
        assert encoder.encode(text).tolist() == library_of(BYTE).encode(text, add_special_tokens=False).ids
    finally:
        bpe.LEAST_CHUNK, bpe.CHUNK_BITS = least, bits


def test_round_trip(documents, nothing):
    library = library_of(BYTE)
    got = Counter(tuple(r) for r in bpe.round_trip(documents, BYTE).collect())
    want = Counter()
    for i, t in docs():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(nothing, BYTE).count() == 0
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents, BYTE), BYTE).collect()} == {i: t or "" for i, t in docs()}


def test_shared_chunks_are_encoded_once():
    encoder = bpe.ChunkEncoder(bpe.vocabulary(BYTE))
    encoder.encode(TEXTS[11])
    before = encoder.encoded
    encoder.encode("Another beginning. " + TEXTS[11])
    assert encoder.encoded - before <= 3 and encoder.reused >= before - 3


# Chats.


def brute_chats(rows, part_turns):
    """rows: (conv_id, turn, role, text), without ties of turn."""
    turns = defaultdict(list)
    for c, t, role, text in {r for r in rows if r[0] is not None}:
        turns[c].append((t is not None, t or 0, role or "unknown", text or ""))
    lists = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    out = set()
    for c, own in lists.items():
        if any(o[: len(own)] == own and (len(o) > len(own) or d < c) for d, o in lists.items() if d != c):
            continue
        for part in range(0, len(own), part_turns):
            lines = [f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in own[part : part + part_turns]]
            out.add((c, part // part_turns, len(own), len(lines), "".join(lines)))
    return out


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    hello, answer, more = ("user", "Hello\n"), ("assistant", "<|im_end|> forged"), ("user", None)
    chats = {1: [hello, answer], 2: [hello, answer, more], 3: [hello, answer, more], 4: [answer, hello], 5: [hello, ("user", "Hello")], 6: [(None, "x" * 50_000)], 7: [hello] * 11, 8: [hello] * 4, 9: [("user", "Hello\n"), ("assistant", "")]}
    rows = [(c, 10 * i - 5, role, text) for c, ts in chats.items() for i, (role, text) in enumerate(ts)]
    rows += [rows[0], (None, 0, "user", "nobody's"), (10, None, "user", "Hello\n"), (10, 3, "assistant", "first"), (11, 4, "user", "Hello\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, n string").repartition(3)
    got = chat.format_chats(df, part_turns=4).collect()
    assert {tuple(r) for r in got} == brute_chats(rows, 4) and len(got) == len({(r.conv_id, r.part) for r in got})
    assert {r.conv_id for r in got} == {2, 4, 5, 6, 7, 9, 10}
    assert chat.format_chats(df.limit(0)).count() == 0


# Packing.


def test_packing(documents, nothing):
    library = library_of(BYTE)
    got = packing.pack(documents, BYTE, capacity=256).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs()]
    assert sum(r.length for r in got) == sum(map(len, ids))
    want = Counter()
    for (i, _), x in zip(docs(), ids):
        first = (len(x) - 1) % 256 + 1
        cuts = [0, *range(first, len(x) + 1, 256)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, piece, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= math.ceil(sum(map(len, ids)) / 256) + 2
    assert packing.pack(nothing, BYTE).count() == 0


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_holds_everything(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert sum(2 * sum(sizes[i] for i in b) <= 50 for b in bins) <= 1


# Media.


def test_media_columns(documents, nothing):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_columns(documents).collect())
    want = Counter()
    for i, t in docs():
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert got == want
    assert media.media_columns(nothing).count() == 0


def test_equal_texts_have_equal_media(documents):
    found = media.media_columns(documents).where("doc_id in (6, 7)").select("media_bytes", "media_sha256", "feature").distinct()
    assert found.count() == 1


def test_archive_ranges_and_damage(spark, documents, tmp_path):
    folder = str(tmp_path / "archives")
    media.store(documents.repartition(2), folder, archiveBytes=2000)
    whole = media.load(spark, folder, rangeBytes=500, batchBytes=1000)
    assert whole.rdd.getNumPartitions() > 2
    assert Counter(r.member for r in whole.collect()) == Counter(None if i is None else str(i) for i, _ in docs())
    victim = whole.where("member = '11'").first()
    path = f"{folder}/{victim.archive}"
    data = bytearray(open(path, "rb").read())
    data[victim.offset + 60] ^= 0xFF
    open(path, "wb").write(bytes(data))
    after = media.load(spark, folder, retries=1).collect()
    assert len(after) == len(docs())
    assert [r.member for r in after if r.media is None] == ["11"] and [r.error for r in after if r.media is None][0]
    errors = media.measured(media.load(spark, folder, retries=0)).where("error is not null").collect()
    assert len(errors) == 1 and errors[0].n_bytes is None


def test_archives_are_added_and_replaced(spark, tmp_path):
    folder, some = str(tmp_path / "archives"), lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id string, text string")
    ids = lambda: sorted(r.member or "?" for r in media.load(spark, folder).collect())
    media.store(some("1", "2"), folder)
    media.store(some("3", None), folder)
    assert ids() == ["1", "2", "3", "?"]
    media.store(some("4"), folder, "overwrite")
    assert ids() == ["4"] and all("4" in media.member_name(n) for z in (tmp_path / "archives").glob("*.zip") for n in zipfile.ZipFile(z).namelist())


def test_any_doc_id_comes_back(spark):
    ids = ["null", "a\0b", "", "../x/y", "é %41 =", "\n", None, "null"]
    got = media.media_columns(spark.createDataFrame([(i, "t") for i in ids], "doc_id string, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)


def test_foreign_members_are_rows_with_errors(spark):
    pngs = [b"", b"no image", media.PNG, media.to_png(b"x")[:40], media.to_png(b"x")]
    found = media.measured(spark.createDataFrame([(str(i), bytearray(m), None) for i, m in enumerate(pngs)], "member string, media binary, error string")).collect()
    assert [r.error is None for r in found] == [False, False, False, False, True]


# Line deduplication.


def brute_lines(rows, least=20, documents=3):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-(2**63) if i is None else i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [len(k := key(x)) >= least and len(holders[k]) >= documents and max(holders[k]) != (-(2**63) if i is None else i) for x in lines]
        left = "\n".join(x for x, d in zip(lines, drop) if not d)
        out[i, len(lines), sum(drop), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


def test_line_dedup(documents, nothing):
    assert Counter(tuple(r) for r in line_dedup.report(documents).collect()) == brute_lines(docs())
    assert line_dedup.report(nothing).count() == 0
    kept = line_dedup.dedup_lines(documents)
    assert kept.columns == [*documents.columns, "n_lines", "n_dropped"] and kept.count() == len(docs())


def test_line_dedup_over_levels(spark):
    rng = np.random.default_rng(4)
    lines = [f"a line of some length, number {i}" for i in range(30)] + ["short"]
    rows = [(int(i), "\n".join(rng.choice(lines, rng.integers(0, 8)))) for i in rng.permutation(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df, batches=11)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()) == brute_lines(rows)


def test_runs_are_compacted(spark):
    index = line_dedup.LineIndex(2)
    for d in range(9, 0, -1):
        index.add(spark.createDataFrame([(d, 1, 1), (d, d, d)], "d long, h1 long, h2 long"))
    assert all(len(level) < line_dedup.FAN_OUT for level in index.levels)
    merged = {(r.h1, r.h2): (r.n, r.last) for r in index.merged().collect()}
    assert merged[1, 1] == (2, 9)  # settled after two documents, and left out from then on
    assert merged[5, 5] == (1, 5)


# Jaccard join.


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, k, part, whole):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and whole * len(x & y) >= part * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return Counter((i, len(x), None if i is None else root(i)) for i, x in sets)


def test_jaccard_join(documents, nothing):
    for k, part in ((4, 85), (5, 80)):
        got = Counter(tuple(r) for r in jaccard_join.near_duplicates(documents, k, (part, 100)).collect())
        assert got == brute_components(docs(), k, part, 100)
    assert jaccard_join.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_on_drifting_copies(spark, seed):
    """Chains of copies, each a few words from the one before, in sizes of all bands."""
    rng = np.random.default_rng(seed)
    rows = []
    for n in (5, 8, 14, 22, 40, 75, 160, 400):
        words = list(rng.choice(WORDS, n))
        for _ in range(12):
            words = list(words)
            for _ in range(rng.integers(0, 2 + n // 60)):
                words[rng.integers(n)] = str(rng.choice(WORDS)) + str(rng.integers(100))
            rows.append(" ".join(words[: n - int(rng.integers(0, 2))]))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100))
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 4, 85, 100)


def test_jaccard_join_of_two_texts_of_one_document(spark):
    """Each text of a doc_id has partners, copies and near copies; they all meet in one component."""
    x, y, z = (common(WORDS, 60, s) for s in (31, 32, 33))
    rows = [(1, x), (2, y), (5, x), (5, y), (7, z), (7, x + " end"), (3, z + " end"), (8, z), (9, common(WORDS, 60, 34)), (4, y + " end"), (5, y), (11, None), (11, "")]
    for order in (rows, rows[::-1]):
        got = jaccard_join.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 4, (85, 100))
        want = {i: 1 for i in (1, 2, 3, 4, 5, 7, 8)} | {9: 9, 11: 11}
        found = [tuple(r) for r in got.collect()]
        assert {(i, c) for i, _, c in found} == set(want.items())
        assert Counter((i, n) for i, n, _ in found) == Counter((i, len(shingle_set(t, 4))) for i, t in rows)


@pytest.mark.parametrize("block, slots", [(2, 1 << 16), (3, 8)])
def test_jaccard_join_of_large_groups(spark, monkeypatch, block, slots):
    """Many documents around one passage, with copies among them: groups split by rare shingles, in small blocks and many sendings."""
    for name, value in (("BLOCK", block), ("GROUP", 40), ("FLUSH", 300), ("SLOTS", slots), ("SLOT_PART", 16), ("FEW", block - 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(8)
    passage, rows = common(WORDS, 60, 40), []
    for _ in range(25):
        own = [str(rng.choice(WORDS)) + str(rng.integers(1000)) for _ in range(rng.integers(4, 40))]
        for _ in range(int(rng.choice([1, 1, 2, 4]))):
            own = list(own)
            own[rng.integers(len(own))] = str(rng.integers(100))
            rows.append(passage + " " + " ".join(own))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    used = []
    monkeypatch.setattr(jaccard_join, "rarest", lambda *a, f=jaccard_join.rarest: used.append(1) or f(*a))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100))
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 4, 85, 100)
    assert used


def test_holders_of_a_signature_send_one():
    sig, d = np.array([5, 5, 5, 9, 7, 7], np.uint64), np.array([3, 1, 2, 4, 8, 6])
    sent = lambda few: tuple(x.tolist() for x in jaccard_join.held(sig, d, np.ones(6, np.int64), few))
    distinct, least, holders, x, pivot, more = sent(1)
    assert (distinct, least, holders) == ([5, 7, 9], [1, 6, 4], [3, 2, 1])
    assert sorted(zip(x, pivot, more)) == [(1, 1, True), (2, 1, True), (3, 1, True), (8, 6, False)]
    distinct, least, holders, x, pivot, more = sent(2)
    assert (sorted(zip(distinct, least)), sorted(holders)) == ([(5, 1), (7, 6), (7, 8), (9, 4)], [1, 1, 1, 3])
    assert sorted(zip(x, pivot)) == [(1, 1), (2, 1), (3, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tÉé中\x1c\x0b", max_size=30)), max_size=12), st.sampled_from([3, 8, 1 << 18]))
def test_word_hashes_tell_words_apart(texts, piece):
    before, hashing.PIECE = hashing.PIECE, piece
    try:
        found = list(hashing.WordHasher().words(texts))
    finally:
        hashing.PIECE = before
    words = [(t or "").encode().lower().split() for t in texts]
    assert [len(h) for h in found] == [len(w) for w in words]
    pairs = {(w, h) for ws, hs in zip(words, found) for w, h in zip(ws, hs.tolist())}
    assert len({w for w, _ in pairs}) == len({h for _, h in pairs}) == len(pairs)


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=6))
def test_sketches_bound_differences(a, more):
    x, y = (np.sort(np.array(list(s), np.uint64)) for s in (a, a | more))
    distance = np.bitwise_count(np.frombuffer(jaccard_join.sketch(x), np.uint8) ^ np.frombuffer(jaccard_join.sketch(y), np.uint8)).sum()
    assert distance <= len(a ^ (a | more))
    if len(a) >= 0.85 * len(a | more) and len(a | more) > 6 and a != a | more:
        bands = jaccard_join.Bands((85, 100))
        assert set(jaccard_join.signatures(x, bands).tolist()) & set(jaccard_join.signatures(y, bands).tolist())


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=20))
def test_sketches_of_different_sizes_bound_differences(a, b):
    x, y = (np.sort(np.array(list(s), np.uint64)) for s in (a, b))
    assert jaccard_join.wide_distance(jaccard_join.sketch(x, 4096), jaccard_join.sketch(y, 1024)) <= len(a ^ b)
    assert jaccard_join.wide_distance(jaccard_join.sketch(x, 2048), jaccard_join.sketch(x, 1024)) == 0


def test_shares_of_group_comparison_are_bounded(spark, monkeypatch):
    """One group of many blocks: shares follow the rows that are dealt, not the members."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "GROUP", 200)
    members = spark.range(400).selectExpr("1L AS pivot", "id AS d", "id AS component", "400L AS size", "9L AS n", "CAST('' AS BINARY) AS sketch", "CAST(NULL AS BINARY) AS wide")
    rows = jaccard_join.dealt(members)
    assert rows.count() == 400 * 40
    assert max(r["count"] for r in rows.groupBy("g").count().collect()) <= 3 * jaccard_join.GROUP
    assert jaccard_join.dealt(members.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()}
    assert got == {x: t for x, t in components.stars((a, b) for a, b in edges if a != b).items()}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# Embeddings.


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    for i in range(0, 200, 2):
        x[i + 1] = x[i] + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.3])
    x[300:360] = x[300] + rng.normal(size=(60, 16)) * 0.05
    x[360:370] = x[360]
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [1.0, 2.0]), (405, []), (5, rows[5][1]), (None, rows[5][1])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    u = np.array([r[1] for r in rows[:400]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    tops = components.stars(zip(*map(np.ndarray.tolist, np.nonzero(linked))))
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(rows)
    hits = sum(found[i].n_links for i in range(400))
    assert 0.98 * linked.sum() <= hits <= linked.sum()
    assert np.mean([found[i].component_id == tops.get(i, i) for i in range(400)]) > 0.98
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(400, 406))
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def links_of(x):
    """Pairs i < j of unit vectors with cosine 0.9 or more, all compared."""
    return {(i + at, j) for at in range(0, len(x), 1000) for i, j in zip(*np.nonzero(x[at : at + 1000] @ x.T >= 0.9)) if i + at < j}


def vectors_of(kind, n, rng):
    """Unit vectors of 64 dimensions, half of them turned from another to a cosine between 0.9 and 0.93."""
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = rng.normal(size=(n // 50, 64))[rng.integers(0, n // 50, n)] + 0.45 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half, turn = n // 2, rng.normal(size=(n // 2, 64))
    turn -= (turn * x[:half]).sum(1, keepdims=True) * x[:half]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.93, size=(half, 1))
    x[half : 2 * half] = cosine * x[:half] + np.sqrt(1 - cosine**2) * turn
    return x


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_of_probing(kind):
    """The lists of a full index, as many as it ever has: a link is found if either side probes the other's list."""
    x = vectors_of(kind, embedding_dedup.SAMPLE, np.random.default_rng(11))
    q = embedding_dedup.Quantiser(x, embedding_dedup.SAMPLE // 32)
    home, probes, _, _ = q.index(x, embedding_dedup.BORDER * math.sqrt(0.2 / 64))
    probes = [set(p) for p in probes]
    want = links_of(x)
    found = sum(home[j] in probes[i] or home[i] in probes[j] for i, j in want)
    assert len(want) >= 10_000 and found >= 0.98 * len(want)


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_of_embedding_dedup(spark, kind, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LIST_SIZE", 32)
    x = vectors_of(kind, 3000, np.random.default_rng(12))
    want = Counter(i for pair in links_of(x) for i in pair)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 3000 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.98 * want.total()


def test_a_cosine_at_the_threshold_is_judged_alike_in_any_block():
    """Many near members make a block dense; the pair at the threshold must not depend on that."""
    rng = np.random.default_rng(13)
    base = embedding_dedup.unit(rng.normal(size=(1, 64)))[0]
    others = embedding_dedup.unit(base + rng.normal(size=(40, 64)) * 0.03)
    far = embedding_dedup.unit(rng.normal(size=(400, 64)))
    pair = embedding_dedup.unit(np.stack([base, 0.9 * base + rng.normal(size=64) * 0.06]))
    exact = float((pair[0] * pair[1]).sum())

    def links(rest, threshold):
        x = np.concatenate([pair, rest])
        q = embedding_dedup.Quantiser(embedding_dedup.unit(np.concatenate([x, far])), 1)
        home, probes, codes, err = q.index(x, 1.0)
        table = pd.DataFrame({"vec_id": range(len(x)), "size": 1, "vec": [v.tobytes() for v in x], "home": home, "probes": probes, "codes": [c.tobytes() for c in codes], "err": err})
        got = embedding_dedup.links_between(q, 0, table[:1], table[1:2] if not len(rest) else table, threshold)
        return int(got.loc[got.node == 0, "links"].sum())

    for threshold in (np.nextafter(exact, 0), exact, np.nextafter(exact, 1)):
        sparse, dense = links(far, threshold), links(others, threshold)
        near = int(((others * base).sum(1) >= threshold).sum())
        assert sparse - int(((far * base).sum(1) >= threshold).sum()) == dense - near == int(exact >= threshold)


# Language model.


def test_lm_scores(documents, nothing):
    got = lm_scoring.score_documents(documents).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in docs() if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in docs():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want[i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_documents(nothing).count() == 0


def test_words_beyond_the_head(documents, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in lm_scoring.score_documents(documents).collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 5)
    assert {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in lm_scoring.score_documents(documents).collect()} == whole


def brute_model(rows):
    """(doc_id, score) from all counts, read to their level."""
    tokens = [(i, [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [b"\n"]) for i, t in rows]
    kept = [w for i, w in tokens if i is None or zlib.crc32(str(i).encode()) % 10]
    c, two = Counter(x for w in kept for x in w), Counter(x for w in kept for x in zip([b"\t", *w], w))
    value = lambda n: float(lm_scoring.VALUES[lm_scoring.level(np.array([n]))[0]])
    level = lambda w: int(lm_scoring.level(np.array([c[w]]))[0])
    seen, scale = {level(a) for a, _ in two}, sum(c.values()) + 0.1 * (len(c) + 1)

    def term(a, b):
        pair, before = value(two[a, b]), len(kept) if a == b"\t" else value(c[a])
        left = 1 - lm_scoring.TRUST if level(a) in seen else 1
        return math.log10(lm_scoring.TRUST * min(pair / max(before, pair, 1), 1) + left * (value(c[b]) + 0.1) / scale)

    return sorted((i is None, i or 0, round(sum(map(term, [b"\t", *w], w)), 5)) for i, w in tokens)


@pytest.mark.parametrize("most", [28, 20])
def test_model_scores_hold_every_count(documents, monkeypatch, most):
    """In one shard, and in several; so many bits that none is read that isn't set."""
    shape, made = lm_scoring.shape, []
    monkeypatch.setattr(lm_scoring, "MOST_BITS", 1 << most)
    monkeypatch.setattr(lm_scoring, "BITS_PER_ENTRY", 800)
    monkeypatch.setattr(lm_scoring, "shape", lambda entries: made.append(shape(entries)) or made[-1])
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 5)) for r in lm_scoring.score_documents(documents).collect())
    assert got == [(a, b, pytest.approx(x, abs=1e-4)) for a, b, x in brute_model(docs())]
    assert (made[0][0] > 1) == (most == 20)


def test_filter_grows_with_its_entries():
    for entries in (0, 10, 26_843_545, 26_843_546, 10**9):
        shards, bits = lm_scoring.shape(entries)
        assert bits <= lm_scoring.MOST_BITS and shards * bits >= lm_scoring.BITS_PER_ENTRY * entries


def test_filter_reads_levels():
    h = lm_scoring.mix(np.arange(1, 5001, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 200, 5000)
    bits = np.zeros(1 << 17, np.uint8)
    size = len(bits) * 8 // lm_scoring.SEGMENTS
    for x, top in zip(h, lm_scoring.level(counts)):
        for number in range(1, top + 1):
            for place in lm_scoring.Filter.places(np.array([x]), number, size):
                at = int(x >> np.uint64(56)) * size + int(place[0])
                bits[at >> 3] |= 1 << (at & 7)
    read = lm_scoring.Filter(bits, {1: 1}).level(h, 1)
    assert (read >= lm_scoring.level(counts)).all() and (read == lm_scoring.level(counts)).mean() > 0.9
    other = lm_scoring.mix(np.arange(10_001, 15_001, dtype=np.uint64))
    assert (lm_scoring.Filter(bits, {1: 1}).level(other, 1) == 0).mean() > 0.9


# Toxicity.


def labelled(spark, n=900):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = list(rng.choice(WORDS, rng.integers(5, 120)))
        for _ in range(toxic * rng.integers(1, 5)):
            words.insert(rng.integers(len(words)), str(rng.choice(["grubblewit", "grubblesnork", "you idiot", "zarkfool"])))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, labels[0], (10**9, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity_on_held_out_rows(spark):
    documents, labels, truth = labelled(spark)
    extra = spark.createDataFrame([(5000, None), (5001, ""), (None, "idiot"), (5002, "x" * 100_000)], "doc_id long, text string")
    got = toxicity.report(documents.unionByName(extra), labels).collect()
    assert len(got) == 904
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.95
    assert toxicity.report(documents.limit(0), labels.limit(0)).count() == 0


def test_toxicity_keeps_columns(spark):
    documents, labels, _ = labelled(spark, 120)
    clash = documents.selectExpr("doc_id", "text", "1 AS features", "2 AS raw", "3 AS score", "4 AS `values`")
    scored = toxicity.fit(documents, labels).transform(clash)
    assert scored.columns == ["doc_id", "text", "features", "raw", "values", "score", "predicted"] and scored.count() == 120


def test_obfuscated_words_count():
    lexicon = toxicity.Lexicon({"stupid": 3.0, "grubble*": 2.0})
    at = {n: i for i, n in enumerate(toxicity.NAMES)}
    plain, hidden = toxicity.features("such a nice day", lexicon), toxicity.features("you st*pid 1d1ot, s.t.u.p.i.d grubblefoo", lexicon)
    assert len(plain) == len(toxicity.NAMES) == len(toxicity.features("", lexicon))
    assert plain[at["obfuscated_hits"]] == 0 and hidden[at["obfuscated_hits"]] >= 2 and hidden[at["lexicon_hits"]] >= 1
    assert toxicity.features("stuuuupid", lexicon)[at["lexicon_hits"]] == 1


def brute_features(text, weights):
    """The features by slow loops over characters and words."""
    letter, word_like = str.isalpha, lambda c: c.isalnum() or c == "_"
    tokens = re.findall(r"[^\W\d_]+", text)
    words, n = [t.lower() for t in tokens], len(tokens)

    def weight(w):
        forms = {w} | {w[:k] + "*" for k in range(1, len(w) + 1)}
        found = max([weights.get(f, 0.0) for f in forms])
        squeeze = lambda x: "".join(c for i, c in enumerate(x) if not i or c != x[i - 1])
        if any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2)):
            found = max([found, *(v for x, v in weights.items() if x[-1] != "*" and squeeze(x) == squeeze(w))])
        return found

    values = [weight(w) for w in words]
    hits, second = [i for i, v in enumerate(values) if v > 0], [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = [min(abs(i - j) for j in second) for i in hits] if second else []
    hidden = re.findall(r"[^\W\d_]+(?:[*@$!#0-9_]+[^\W\d_]+)+", text) + re.findall(r"(?<!\w)[^\W\d_](?:[.\- ][^\W\d_]){3,}(?!\w)", text)
    lexicon = toxicity.Lexicon(weights)
    per, count = 1 / max(n, 1), lambda test: sum(map(test, text))
    seeds = sum(w in toxicity.SEEDS for w in words)
    held = [values[i] for i in hits]
    return [
        math.log1p(n), seeds * per, seeds, len(hits), len(hits) * per, len({words[i] for i in hits}), max(held, default=0.0), sum(held) / len(held) if held else 0.0,
        max((sum(i <= j < i + 50 for j in hits) for i in hits), default=0), len(second) * per, 1 / (1 + min(near)) if near else 0.0, sum(g <= 10 for g in near),
        count(str.isupper) / max(1, count(letter)), sum(len(t) > 2 and t.isupper() for t in tokens) * per, text.count("!") * per, text.count("?") * per,
        count(lambda c: 33 <= ord(c) < 48 or 58 <= ord(c) < 65 or 91 <= ord(c) < 97) / max(1, len(text)), count(lambda c: "0" <= c <= "9") / max(1, len(text)),
        len(re.findall(r"[!?]{2,}", text)) * per, len(hidden) * per, sum(map(lexicon.hidden, hidden)), len(re.findall(r"([^\W\d_])\1\1", text)) * per,
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["you", "Idiot", "STUPID", "stuuupid", "st*p1d", " ", " ", " ", "s.t.u.p.i.d", "a b c d", "!?", "!!", "?", "ÉTÉ", "ñoño", "du", "grubblefoo", "x_y", "9", "\n", "中", "-", "aaa", "ß"]), max_size=40))
def test_features_by_brute_force(parts):
    weights = {"stupid": 3.0, "grubble*": 2.0, "été": 1.5}
    text = "".join(parts)
    assert toxicity.features(text, toxicity.Lexicon(weights)) == pytest.approx(brute_features(text, weights))


@pytest.mark.parametrize("n_toxic, n_clean", [(0, 4), (3, 0), (1, 1), (2, 200)])
def test_toxicity_of_few_labels(spark, n_toxic, n_clean):
    """With one class only the rate; else whatever was learned, toxic ones above clean ones."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic, clean = ids[:n_toxic], ids[n_toxic : n_toxic + n_clean]
    rows = [(i, common(WORDS, 30, i) + " you idiot, you moron") for i in toxic] + [(i, common(WORDS, 30, i)) for i in clean]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in toxic + clean] + [(10**6, 1), (10**6 + 1, 0)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.report(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert len(score) == len(rows) and all(0 <= x <= 1 for x in score.values())
    if not n_toxic or not n_clean:
        assert set(score.values()) == {float(bool(n_toxic))}
    elif n_toxic > 1:
        assert min(score[i] for i in toxic) > np.mean([score[i] for i in clean])


# Round trips between ways to the same result, and ids that are no numbers.


def test_vectors_of_every_length_link_among_themselves(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(50)] + [(100, [1.0, 2.0]), (101, [0.5, 1.0]), (102, [2.0, -1.0]), (200, [1.0, 0.0, 3.0]), (201, [2.0, 0.0, 6.0]), (202, [1.0, 2.0, 0.0]), (300, [5.0]), (301, [-5.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: got[i] for i in range(100, 302) if i in got} == {100: (1, 100), 101: (1, 100), 102: (0, 102), 200: (1, 200), 201: (1, 200), 202: (0, 202), 300: (0, 300), 301: (0, 301)}


def test_scores_of_a_filter_that_stays_a_table(documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "MOST_BITS", 1 << 14)
    made, shape = [], lm_scoring.shape
    monkeypatch.setattr(lm_scoring, "shape", lambda entries: made.append(shape(entries)) or made[-1])
    ways = []
    for broadcast, piece, probed in ((1_000, 2_000_000, 4_000_000), (0, 2_000_000, 4_000_000), (0, 3_000, 300)):
        monkeypatch.setattr(lm_scoring, "PIECE", piece)
        monkeypatch.setattr(lm_scoring, "PROBED", probed)
        ways.append(sorted(map(repr, map(tuple, lm_scoring.score_documents(documents, broadcast=broadcast).collect()))))
    assert made[0][0] > 1 and ways[0] == ways[1] == ways[2]


def test_calibration_never_sees_what_teaches(spark):
    rows = [(i, common(WORDS, 20, i)) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 7)) for i in range(40)], "doc_id long, toxic int")
    chosen, counts = toxicity.sampled(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    found = Counter((r.toxic, r.calibrates) for r in chosen.collect())
    assert all(abs(found[c, True] - counts[c] / 3) < 1 and found[c, False] for c in (0, 1))


def test_lines_that_all_texts_have_tell_no_copies(spark):
    texts = [f"\n\n{common(WORDS, 30, i)}\n--\n\nshort {i}" for i in range(200)]
    where, coalesce = defaultdict(set), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        placed = bpe.near_each_other(spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string"))
        for r in placed.select("text", F.spark_partition_id().alias("p")).collect():
            where[r.text].add(r.p)
    finally:
        spark.conf.set(coalesce, before)
    # but for those at the borders of partitions
    assert len({p for ps in where.values() for p in ps}) > 1 and sum(len(ps) == 1 for ps in where.values()) > 180


def test_ids_that_are_no_numbers(spark):
    numbers = spark.createDataFrame([("7", "text of a line, long enough\nx"), (None, "y")], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack(numbers, BYTE).collect()} == {7, None} and line_dedup.report(numbers).count() == 2
    words = spark.createDataFrame([("seven", "text of a line, long enough\nx")], "doc_id string, text string")
    for run in (lambda: packing.pack(words, BYTE), lambda: line_dedup.report(words)):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            run().collect()
