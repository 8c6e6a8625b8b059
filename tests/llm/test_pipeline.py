"""The pipeline and each of its stages against brute force on a small table with planted cases."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sleuthframe.llm import line_dedup, toxicity

from .test_operators import BYTE, WORDS, brute_components, common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, predicted int, n_lines long, row string, d string"
SHARED = "A line of licence text that many of the documents hold"


def planted():
    """Rows, and the doc_ids of toxic ones with their labels."""
    rows, labels = [], {}
    for i in range(160):
        words = list(np.random.default_rng(i).choice(WORDS, 30 + i % 40)) + [f"own{i}", f"more{i}"]
        labels[i] = int(i % 5 == 0)
        for k in range(labels[i] * 4):
            words.insert(5 * k, ["you idiot", "grubblewit", "zarkfool", "you moron"][k])
        rows.append((i, " ".join(words) + ("\n" + SHARED.upper() if i % 9 == 0 else "")))
    near = rows[33][1].split()
    near[10] = "changed"
    rows += [(200, rows[33][1]), (201, rows[33][1]), (202, " ".join(near)), (203, None), (204, ""), (205, "\n\n"), (206, common(WORDS, 4000, 99)), (207, "two words"), (208, "two words"), (33, rows[33][1]), (None, rows[34][1]), (None, None)]
    return rows, {i: t for i, t in labels.items() if i % 4}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rows, labels = planted()
    table = [(i, t, "en", "web", len(t or ""), 7.0, 8, 9, "clash", "clash") for i, t in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def check_columns(df):
    assert df.schema.simpleString() == "struct<" + SCHEMA.replace(" long", ":bigint").replace(" string", ":string").replace(" int", ":int").replace(" double", ":double").replace(", ", ",") + ">"
    assert {tuple(r) for r in df.select("score", "predicted", "n_lines", "row", "d").collect()} <= {(7.0, 8, 9, "clash", "clash")}


def brute_lines_left(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    number = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(number(i))
    keep = lambda i, x: len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == number(i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if keep(i, x))) for i, t in rows]


def brute_one_of_each(rows):
    top = {i: c for i, _, c in brute_components(rows, 5, 80, 100)}
    out, seen = [], set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        if i is None or top[i] == i and i not in seen:
            out.append((i, t))
            seen.add(i)
    return out


def test_every_stage_and_the_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    check_columns(clean)
    verdict = {r.doc_id: r.predicted for r in toxicity.report(docs.where("doc_id is not null"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    kept = Counter({(i, t): n for (i, t), n in rows_of(docs).items() if i is None or not verdict[i]})
    assert rows_of(clean) == kept
    toxic = {i for i in range(0, 160, 5)}
    assert len({i for i, p in verdict.items() if p} & toxic) >= 0.8 * len(toxic) and len({i for i, p in verdict.items() if p} - toxic) <= 5
    lines = corpus_pipeline.drop_shared_lines(spark, clean, sf_dir)
    check_columns(lines)
    left = brute_lines_left(list(kept.elements()))
    assert rows_of(lines) == Counter(left)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert sum(SHARED.lower() in t.lower() for _, t in left) == 1
    single = corpus_pipeline.drop_near_duplicates(spark, lines, sf_dir)
    check_columns(single)
    one = brute_one_of_each(left)
    assert rows_of(single) == Counter(one)
    # 33 and 200 have lost their only line to 201, of which 202 is a near copy
    assert not {202, 208} & {i for i, _ in one} and {33, 200, 201, 203, 204, 205, 207} <= {i for i, _ in one}
    library = Tokenizer.from_file(BYTE)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    want = Counter()
    for i, t in one:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_stages_of_an_empty_table(spark, sf_dir):
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, nothing, sf_dir)
        assert out.columns == nothing.columns and out.count() == 0
    assert corpus_pipeline.pack(spark, nothing, sf_dir).count() == 0


def test_lines_without_a_count_of_characters(spark):
    docs = spark.createDataFrame([(i, SHARED + "\nown " + str(i)) for i in range(4)], "doc_id long, text string")
    left = line_dedup.without_shared_lines(docs)
    assert left.columns == docs.columns and rows_of(left) == Counter(brute_lines_left([(i, SHARED + f"\nown {i}") for i in range(4)]))
