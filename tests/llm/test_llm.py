"""The training-data operators: twins in SQL, brute force, round trips, and odd inputs."""

from __future__ import annotations

import array
import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from twins import DATA, same

from leafmill.llm import attention, bpe, common, lattice, lines, lm, packing, pii, quality, registry, simhash, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a  b\n\n c\t\td 'll don't x　　y   z  ", "x" * 5000, "ab" * 400 + " " * 500 + "cd", "12 34'll've " * 200, "\x1c\x1d a\x1eb  \x1f c", "日本語" * 500, " lead", " trail ", "\n\n\nfoo\n\n\n", "same text", "same text"]


def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents hold odd texts, nulls in every column, repeated rows, and clashing extra columns."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", "src0", None, "extra", 1) for i, t in enumerate(ODD)] + [(None, None, None, None, None, None, None), (3, "same text", None, "x", 9, "y", 2), (3, "same text", None, "x", 9, "y", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, _row int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/none.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, name):
    same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_quality", "op4_lines"])
def test_twin_on_odd_documents(spark, odd, name):
    same(registry.queries()[name](spark, odd), registry.oracle_sql()[name], odd)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ("op2_urls", "op5_warc", "op10_lattice")])
def test_empty_documents(spark, tmp_path, odd, name):
    spark.read.parquet(f"{odd}/none.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0


def test_empty_other_tables(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for f in (urls.op2_urls, warc.op5_warc, lattice.op10_lattice):
        assert f(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def encoding():
    return bpe.coder(public_tokenizers.path(bpe.RANKS))


@pytest.mark.parametrize("chunk", [(bpe.CHUNK, bpe.OVERLAP), (60, 16)])
def test_bpe_equals_the_library_and_decodes(spark, odd, encoding, chunk):
    rows = spark.read.parquet(f"{odd}/documents.parquet").selectExpr("text", "text as original", "1 as _row", "2 as _text", "3 as _in", "'x' as ids")
    out = bpe.decode(bpe.encode(rows, chunk=chunk[0], overlap=chunk[1], spread=3))
    assert out.columns == ["original", "_row", "_text", "_in", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert list(memoryview(r.ids).cast("I")) == encoding.encode_ordinary(r.original or "")
        assert bytes(r.decoded).decode() == (r.original or "") and (r._row, r._text, r._in) == (1, 2, 3)


@pytest.mark.parametrize("chunk", [(4096, 512), (60, 16)])
def test_bpe_stitches_texts(spark, encoding, chunk):
    """Texts of many chunks go by their pieces; one without a common boundary is known as such."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdé'1 \n日"), rng.integers(1, 9)))
    docs = [" ".join(word() for _ in range(4000)) for _ in range(5)] + ["z" * 20_000]
    rows = spark.createDataFrame(list(enumerate(docs)), "_row long, _text string")
    cuts = {r._row: r._cut for r in bpe.stitches(bpe.chunked(rows, *chunk), *chunk).collect()}
    assert all(len(cuts[i]) > 3 for i in range(6)) and None in cuts[5]
    if chunk[0] > 1000:
        assert all(None not in cuts[i] for i in range(5))
    for i, text in enumerate(docs):
        pieces = bpe.pieces_of(text, *chunk)
        assert (pieces is None) == (None in cuts[i]) and (pieces is None or "".join(pieces) == text and [sum(map(len, pieces[: k + 1])) - chunk[0] * (k + 1) for k in range(len(pieces) - 1)] == cuts[i])
    for spread in (2, 1000):
        for r in bpe.encode(rows.withColumnRenamed("_text", "text"), chunk=chunk[0], overlap=chunk[1], spread=spread).collect():
            assert list(memoryview(r.ids).cast("I")) == encoding.encode_ordinary(docs[r._row])


def test_bpe_query(spark, encoding):
    docs = texts()
    for r in bpe.op3_bpe(spark, DATA).collect():
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    assert sum(len(t) > bpe.CHUNK + bpe.OVERLAP for t in docs.values()) >= 20  # which are stitched


def test_packing_places_every_token_once(spark):
    docs, t = texts(), Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, packing.END] for i, x in docs.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op9_packing(spark, DATA).collect():
        some = ids[r.doc_id][r.start : r.start + r.length]
        assert len(some) == r.length and zlib.crc32(array.array("I", some).tobytes()) == r.ids_crc32
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        p = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and sum(r.length for r in p) == len(x) and all(r.length == packing.SIZE for r in p[1:])
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= packing.SIZE
    assert len(sequences) <= 1.02 * sum(map(len, ids.values())) / packing.SIZE + 1


def test_plan_on_random_histograms():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 64, 12), rng.integers(1, 50, 12), strict=True)}
        room, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for length, first, n, sequence, offset in packing.plan(counts, 64):
            ranks[length] += range(first, first + n)
            for k in range(n):
                room[sequence + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
        for placed in room.values():
            at = 0
            for offset, n in sorted(placed):
                assert offset == at
                at += n
            assert at <= 64
        assert sorted(room) == list(range(len(room)))


def test_plan_fills_a_room_with_several_pieces_of_a_length():
    made = lambda counts, size: max(s + n for _, _, n, s, _ in packing.plan(counts, size))
    assert made({1100: 10, 300: 30}, 2048) == 10
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 64, 6), rng.integers(1, 50, 6), strict=True)}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                best = min((i for i, r in enumerate(rooms) if r >= length), key=lambda i: rooms[i], default=None)
                if best is None:
                    rooms.append(64)
                rooms[-1 if best is None else best] -= length
        assert made(counts, 64) == len(rooms)


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    import xxhash

    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, odd):
    for folder in (DATA, odd):
        rows = simhash.op7_simhash(spark, folder).collect()
        docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet{'/*.parquet' if folder == odd else ''}'").fetchall()
        assert sorted((str(i), f"{brute_fingerprint(t):016x}") for i, t in docs) == sorted((str(r.doc_id), r.fingerprint) for r in rows)
        codes = np.array(sorted({int(r.fingerprint, 16) for r in rows}), dtype=np.uint64)
        near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 2
        label = lattice._forest(near & ~np.eye(len(codes), dtype=bool))
        place = {int(c): k for k, c in enumerate(codes)}
        least = {}
        for r in rows:
            k = label[place[int(r.fingerprint, 16)]]
            if r.doc_id is not None:
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
        assert all(r.component_id == least.get(label[place[int(r.fingerprint, 16)]]) for r in rows)


@pytest.mark.parametrize("hot", [200_000, 40, 5])
def test_gray_index_finds_all_links(spark, hot):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    dense = np.uint64(99) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    cube = np.arange(256, dtype=np.uint64) << np.uint64(30)  # agree on all blocks but one, however often they are dealt out
    codes = np.unique(np.concatenate([base, base ^ np.uint64(1 << 40), base ^ np.uint64(3), base ^ np.uint64(7 << 20), dense, cube]))
    i, j = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= 2, 1))
    s = codes.view(np.int64)
    want = {(int(max(s[a], s[b])), int(min(s[a], s[b]))) for a, b in zip(i, j, strict=True)}
    got = simhash.near_links(spark.createDataFrame([(int(x),) for x in s], "fp long"), 2, hot).collect()
    assert {(r.a, r.b) for r in got} == want


def test_one_of_each_keeps_one_row(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = simhash.one_of_each(spark, docs).collect()
    rows = simhash.near_duplicates(common.wrapped(docs, "doc_id", "text")).collect()
    assert len(kept) == len({r.root for r in rows})
    assert set(kept[0].asDict()) == set(docs.columns)


def test_one_of_each_tells_groups_with_equal_ids_apart(spark):
    texts = {"a": "one two three four five six", "b": "quite another text that shares no words", "c": "a third one with nothing of the others"}
    rows = [(5, texts["a"]), (5, texts["b"]), (7, texts["b"]), (None, texts["c"]), (None, texts["c"]), (9, texts["a"])]
    kept = simhash.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted(texts.values())
    assert {r.doc_id for r in kept} == {5, None}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


HARD = ["a@b.com_x@c.de y@z a.b@c-d.ef.gh.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.0255 999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 5" + "0 1" * 9000, "+1 (415) 555-0000 ++1234567890 +1((((((5 +49 170 1234567", "x" * 60000, "9" * 30000, "a@b" + ".c" * 20000, "日本 a@é.com ü@ü.de ñ+1 22 333 4444 55", " .@a.b @a.b a@.b a@b.", "1.1.1.1é2.2.2.2", "+1 415 555 0000 4111111111111111 a@4111111111111111.com", None, ""]


def test_pii_base_spans(spark, tmp_path):
    spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, docs in ((DATA, texts()), (str(tmp_path), dict(enumerate(HARD)))):
        for r in pii.op8_pii(spark, folder).collect():
            want = brute_spans(docs[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]


def test_pii_context_finds_and_leaves_alone(spark):
    rows = [(i, f"please contact user{i}@mail{i}.example.com today") for i in range(30)] + [(50, "please contact AB12CD34EF today"), (51, "serial AB99CD99EF here"), (52, "version 2.0.1 of it")]
    docs = spark.createDataFrame(rows, "_row long, text string")
    found = {r._row: [s.kind for s in r.spans] for r in pii.find(docs).collect()}
    assert found[50] == [4] and found[51] == [] and found[52] == [] and found[0] == [0]


def test_pii_found_identifiers_are_seeds_and_marked_everywhere(spark):
    rows = [(i, f"please contact user{i}@mail{i}.example.com today") for i in range(30)]
    rows += [(100 + i, f"please contact AB12CD{i}4EF today") for i in range(8)] + [(200 + i, f"badge AB12CD{i}4EF issued") for i in range(8)]
    rows += [(300, "badge ZZ77YY88 issued"), (301, "serial AB12CD34EF here"), (302, "AB12CD04EF"), (303, "serial QQ99CD99EF here")]
    found = {r._row: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "_row long, text string")).collect()}
    assert all(found[i] == [4] for i in (*range(100, 108), *range(200, 208), 300, 301, 302)) and found[303] == []


def brute_ids(docs):
    """Spans of found identifiers by a plain reading of the rules, over lists."""
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", t)
    seen, totals = [], collections.Counter()
    for row, text in docs:
        base = [(a, b, True) for a, _, b in brute_spans(text)]
        ids = [(m.start(), m.end(), False) for m in regex.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z_-]*[0-9][A-Za-z0-9_-]*", text) if 8 <= len(m[0]) <= 128 and len(re.sub("[^0-9]", "", m[0])) >= 3]
        ids = [(a, b, k) for a, b, k in ids if not any(x < b and a < y for x, y, _ in base)]
        for a, b, known in base + ids:
            left, right = words(text[max(a - 80, 0) : a].lower())[-2:], words(text[b : b + 80].lower())[:2]
            patterns = {f"L:{w}" for w in left[-1:]} | {f"R:{w}" for w in right[:1]} | {f"L:{' '.join(left)}" for _ in left[1:]} | {f"R:{' '.join(right)}" for _ in right[1:]}
            instance = text[a:b]
            secret = re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", instance) and re.search("[a-fA-F]", instance)
            seen.append((row, a, b, known, instance, patterns, known or bool(secret)))
        w = words(text.lower())
        totals.update(w + [" ".join(p) for p in zip(w, w[1:], strict=False)])
    seeds = {i for _, _, _, _, i, _, s in seen if s}
    score = {i: 1_000_000 for i in seeds}
    for _ in range(pii.ROUNDS):
        by = collections.defaultdict(collections.Counter)
        for _, _, _, _, i, patterns, _ in seen:
            for q in patterns:
                by[q][i] += 1
        p = {q: sum(n * score.get(i, 0) for i, n in c.items()) // max(sum(c.values()), totals[q[2:]]) for q, c in by.items() if sum(score.get(i, 0) > 0 for i in c) >= pii.SEEDS}
        good = {q: v for q, v in p.items() if v >= pii.TRUST}
        value = {}
        for _, _, _, _, i, patterns, _ in seen:
            for q in patterns & good.keys():
                value[i] = max(value.get(i, 0), good[q])
        score = value | {i: 1_000_000 for i in seeds}
    return {(row, a, b) for row, a, b, known, i, patterns, _ in seen if not known and (i in value or patterns & good.keys())}


def test_pii_graph_scores_against_brute_force(spark):
    rng = np.random.default_rng(9)
    code = lambda: "".join(rng.choice(list("ABC0123456789"), 9)) + "123"
    word = lambda: str(rng.choice(["the", "of", "and", "log", "über", "it's", "key", "is"]))
    pool, docs = [code() for _ in range(25)], []
    for i in range(400):
        value = [f"u{i}@m{i}.org", str(rng.choice(pool)), code(), "".join(rng.choice(list("0123456789abcdef"), 40)), f"+1 415 555 {i:04d}"][rng.integers(5)]
        before = [["account", "no"], ["badge"], ["my", "token ="], ["the"], []][rng.integers(5)]
        docs.append((i, " ".join([word(), word(), *before, value, *(["for you"] if rng.random() < 0.4 else [word()]), word()])))
    got = {(r._row, s.start, s.end) for r in pii.find(spark.createDataFrame(docs, "_row long, text string")).collect() for s in r.spans if s.kind == 4}
    want = brute_ids(docs)
    assert got == want and 20 < len(want) < 380


def test_pii_redacts(spark, odd):
    docs = spark.createDataFrame([(1, "call +1 (415) 555-0000 or a@b.com", "en", "s", 33)], "doc_id long, text string, lang string, source string, n_chars long")
    r = pii.redact(spark, docs).collect()[0]
    assert r.text == "call <PHONE> or <EMAIL>" and r.n_chars == len(r.text)
    assert pii.redact(spark, spark.read.parquet(f"{odd}/documents.parquet").drop("_row")).count() == len(ODD) + 3


def test_lines_template_with_variable_field(spark):
    line = "posted by user {} on the public board today"
    rows = [(i, f"{chr(97 + i) * 3} {chr(98 + i) * 4} {chr(99 + i) * 5} own\n{line.format(['ann', 'bob', 'eve', 'joe'][i])}\nshort") for i in range(4)]
    out = {r.doc_id: r for r in lines.dedup(common.with_row_id(spark.createDataFrame(rows, "doc_id long, text string"), "_row")).collect()}
    assert "posted by" in out[0].text and all("posted by" not in out[i].text for i in (1, 2, 3))
    assert out[0].text.endswith("short") and all(out[i].text.endswith("own") and out[i].n_dropped == 2 for i in (1, 2, 3))


def test_lines_equal_ones_recur(spark):
    """Short lines and lines of numbers from three documents on, passages of 50 words from two on."""
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    rows = [(0, f"Read more\n(c) 2024 12 34 56\n{passage}\nalpha"), (1, f"Read more\n{passage}\n(c) 2024 12 34 56\nbeta"), (2, "Read more\ngamma\n(c) 2024 12 34 56\nonly two"), (3, "only two\n(c) 2025 12 34 56")]
    out = {r.doc_id: r.text for r in lines.dedup(common.with_row_id(spark.createDataFrame(rows, "doc_id long, text string"), "_row")).collect()}
    assert out == {0: rows[0][1], 1: "beta", 2: "gamma\nonly two", 3: rows[3][1]}


def test_quality_rejects_outliers_and_keeps_the_rest(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    good = [" ".join(word() for _ in range(rng.integers(60, 300))) for _ in range(200)]
    bad = [" ".join(word() + "###" for _ in range(100)) for _ in range(30)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.op1_quality(spark, str(tmp_path)).where("kept").collect()}
    assert kept == set(range(len(good)))


def robust_distances(x):
    """Squared distances to the reweighted estimate of least determinant, by numpy."""
    floor = np.array(quality.LEAST_SD, float)
    middle = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), floor)

    def estimate(rows, factor):
        cov = np.cov(rows.T, bias=True) * factor
        cov[np.diag_indices(5)] = np.maximum(cov.diagonal(), floor**2) + floor**2 / 100
        return rows.mean(axis=0), cov

    def distances(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    found = []
    for d2 in ((((x - middle) / spread) ** 2).sum(axis=1), np.abs((x - middle) / spread).max(axis=1)):
        for _ in range(quality.STEPS + 1):
            bins = np.minimum(np.floor(d2 * 16), quality.BINS)
            model = estimate(x[bins <= np.quantile(bins, 0.5)], quality.RAW)
            d2 = distances(*model)
        found.append((np.linalg.det(model[1]), d2))
    d2 = min(found, key=lambda f: f[0])[1]
    return distances(*estimate(x[d2 <= quality.INNER], 1.0))


def test_quality_against_numpy_and_small_groups(spark):
    """Large groups by themselves, small ones by their language, rare languages by the corpus."""
    rng = np.random.default_rng(7)
    rows = []
    for lang, source, n in (("en", "a", 300), ("en", "b", 90), ("en", "c", 7), ("xx", "a", 5), (None, None, 60)):
        for _ in range(n):
            words = int(rng.lognormal(5, 0.7)) + 10
            rows.append((len(rows), lang, source, words, int(words * rng.normal(5, 0.3)), int(rng.integers(0, 4) * words // 50), int(rng.integers(0, 2)), int(rng.integers(0, 2) * words // 10), int(words // 9 + 2), False))
    rows += [(1000, "en", "c", 100, 1900, 0, 0, 0, 12, False), (1001, "xx", "a", 100, 500, 300, 0, 0, 12, False), (1002, "xx", None, 100, 500, 300, 0, 0, 12, True)]
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_lines long, base_failed boolean"
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, schema)).collect()}
    x = np.array([[math.floor(1000 * v + 0.5) for v in (math.log(r[3]), math.log(r[4] / r[3]), math.log(1 + r[5] / r[3]), math.log(1 + r[6] / r[8]), math.log(1 + r[7] / r[3]))] for r in rows], float)
    passed = np.array([not r[9] for r in rows])
    for i, r in enumerate(rows):
        if r[9]:
            assert got[r[0]].d2 is None and not got[r[0]].kept
            continue
        own = np.array([o[1:3] == r[1:3] for o in rows]) & passed
        lang = np.array([o[1] == r[1] for o in rows]) & passed
        group = own if own.sum() >= quality.LEAST else lang if lang.sum() >= quality.LEAST else passed
        assert got[r[0]].d2 == pytest.approx(robust_distances(x[group])[np.flatnonzero(group).searchsorted(i)], rel=1e-6)
    assert not got[1000].kept and not got[1001].kept


def test_urls_longest_rule_and_odd_urls(spark):
    cases = {"http://A.Example.COM/en/7x?q": "allow", "https://b.com/en/": "block", "http://com/en/": "block", "http://xcom/en/": "allow", "http://x.example.net/de/8": "block", "http://net/de/": "allow", "x.com/en/": "allow", None: "allow", "": "allow", "http://": "allow", "http://b.com/en": "allow"}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2, "page_id long, url string")
    rules = spark.createDataFrame([*urls.RULES, ("block", "com", "/en/"), ("allow", "org", None)], "verdict string, host string, path string")
    for ranges in (2, 7):
        got = urls.judge(df, rules, ranges).collect()
        assert len(got) == 2 * len(cases)
        assert all(r.verdict == list(cases.values())[r.page_id] for r in got)


def test_urls_nested_rules_against_brute_force(spark):
    rng = np.random.default_rng(4)
    host = lambda: ".".join(rng.choice(list("ab"), rng.integers(1, 4)))
    path = lambda: "/" + "".join(rng.choice(list("ab/"), rng.integers(0, 5)))
    rules = {(host(), path()): str(rng.choice(["allow", "block"])) for _ in range(60)}
    pages = [(i, host(), path()) for i in range(300)]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in pages], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string"), 9).collect()}
    for i, h, p in pages:
        fit = [(-len(a + b), -len(a), a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        assert got[i] == ((min(fit)[2], min(fit)[3]) if fit else (None, "allow"))


def test_warc_looks_up_by_key(spark, tmp_path):
    html = ["x" * 1200, "x" * 1200, "small", "small", None, "ü" * 700, "ü" * 700]
    df = spark.createDataFrame([(i, f"http://h{i % 3}.org/p?{i}" if i != 4 else None, t) for i, t in enumerate(html)], "page_id long, url string, html string")
    root = f"file://{tmp_path}"
    captures = warc.write(df, root)
    files = warc.index(captures, root)
    got = {r.page_id: r for r in warc.lookup(captures.select("key").distinct(), root, files).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {0: ("revisit", 1), 1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 6), 6: ("response", None)}
    assert all(r.payload_bytes == len((html[i] or "").encode()) and r.payload_digest == hashlib.sha1((html[i] or "").encode()).hexdigest() for i, r in got.items())
    one = warc.lookup(spark.createDataFrame([(warc.surt("http://h0.org/p?3"),), ("absent",)], "key string"), root, files).collect()
    assert [r.page_id for r in one] == [3]


def test_warc_hot_keys_and_odd_rows(spark, tmp_path, monkeypatch):
    """One key with most captures over many index blocks, null and equal ids, repeated rows, long payloads."""
    monkeypatch.setattr(warc, "SPAN", 64)
    rows = [(i, None if i % 3 else f"http://h.org/{i}", f"page {i}") for i in range(2000)]
    rows += [(None, None, "y" * 3000), (5, None, "y" * 3000), (5, None, "y" * 3000), (9000, "http://h.org/9000", "z" * 500_000), (9001, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = f"file://{tmp_path}"
    captures = warc.write(df, root)
    files = warc.index(captures, root)
    spans = warc.lookups(captures)
    assert spans.where("key = ')'").count() > 20
    got = warc.lookup(spans, root, files, 7).collect()
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted((str(i), hashlib.sha1((t or "").encode()).hexdigest()) for i, _, t in rows)
    same_payload = [(r.record_type, r.page_id, r.refers_to) for r in got if r.payload_bytes == 3000]
    assert sorted(map(str, same_payload)) == ["('response', 5, None)", "('revisit', 5, 5)", "('revisit', None, 5)"]


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8)) * 3
    c = lattice.decode(x)
    d = ((x - c) ** 2).sum(axis=1)
    other = ((x[:, None] - c[:, None] - lattice.roots()[None]) ** 2).sum(axis=2).min(axis=1)
    assert (d <= other + 1e-9).all() and len(lattice.roots()) == 240 and (np.rint(2 * c) == 2 * c).all()


@pytest.mark.parametrize("block", [lattice.BLOCK, 64])
def test_lattice_dense_clusters_and_odd_vectors(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(3, 16))
    rows = [(k, (centre[k % 3] + rng.normal(size=16) * 0.01).tolist(), k % 2) for k in range(600)]
    rows += [(5000 + k, centre[0].tolist(), 0) for k in range(100)] + [(7000, None, 0), (7001, [0.0] * 16, 0), (7002, [float("nan")] * 16, 1), (7003, [None, *[1.0] * 15], 1), (7004, centre[0].tolist(), None), (None, centre[0].tolist(), 0), (0, centre[0].tolist(), 0), (7006, [1.0], 0), (7007, [2.0], 0), (7008, [], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, groups = {}, collections.defaultdict(list)
    for k, (i, e, label) in enumerate(rows):
        want[k] = (i, 0, i, True)
        if label is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e):
            groups[label, len(e)].append(k)
    for ks in groups.values():
        u = np.array([rows[k][1] for k in ks])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        m = u @ u.T >= lattice.COSINE
        np.fill_diagonal(m, False)
        f = lattice._forest(m)
        for a, k in enumerate(ks):
            ids = [rows[ks[x]][0] for x in np.flatnonzero(f == f[a]) if rows[ks[x]][0] is not None]
            least = min(ids) if ids else None
            want[k] = (rows[k][0], int(m[a].sum()), least, rows[k][0] == least)
    got = sorted(map(str, (tuple(r) for r in lattice.op10_lattice(spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, want.values()))


def test_lines_are_their_own_tokens(spark):
    """Masked tokens, their number and the leaf of a line, whether it is taken as it stands or cut into tokens; no array of tokens is carried."""
    own = ["a", "a b", "a b c d", "a b c e", "\u00e9 \xa0 \u3000x", "<*> b c d", "a,b-c"]
    cut_up = ["a  b c d", "a\tb c\x0bd", "a \x0c b\rc e", "a1 b c d", "9 b c d", "x2\t\t3y z", "a b c d5  ", "\t a b c d"]
    rows = [(i, i, line) for i, line in enumerate([*own, *cut_up])] + [(90, 90, None), (91, 91, " \t\r\n\n\x0b"), (92, 92, "one\n\n two  2 \nend")]
    got = lines._lines(spark.createDataFrame(rows, "_row long, doc_id long, text string"))
    assert dict(got.dtypes)["_m"] == "string" and not any(t.startswith("array") for t in dict(got.dtypes).values())
    want = {}
    for row, _, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in WORD.findall(line)]
            if tokens:
                want[row, at] = tokens
    got = {(r._row, r.line): r for r in got.collect()}
    assert {k: (r._m, r.n) for k, r in got.items()} == {k: (" ".join(t), len(t)) for k, t in want.items()}
    for a, b in itertools.combinations(want, 2):
        assert (got[a].leaf == got[b].leaf) == (len(want[a]) == len(want[b]) and want[a][: lines.DEPTH] == want[b][: lines.DEPTH])


def test_lm_base_scores(spark, odd):
    for folder in (DATA, odd):
        docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet{'/*.parquet' if folder == odd else ''}'").fetchall()
        tokens = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
        c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
        ends = held.count(False)
        n, v = sum(c.values()) + ends, len(c) + 1
        log = lambda x: math.log10((x + 1) / (n + v + 1))
        want = sorted((str(i), h, len(t) + 1, sum(c[w] > 0 for w in t) + 1, n, round(sum(log(c[w]) for w in t) + log(ends), 5)) for (i, _), t, h in zip(docs, tokens, held, strict=True))
        got = lm.op6_lm(spark, folder).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_attention_is_a_distribution_and_causal():
    counts = np.zeros(3000, np.int64)
    counts[:2000] = np.arange(2000, 0, -1)
    u = attention.units(counts)
    m = attention.start(u)
    x, begins, unit, keep = windows_of([u.unit[[5, 7, 11, 13]]])
    total = 0.0
    for t in range(3000):
        total += math.exp(attention.log_probs(m, x, begins, np.full_like(unit, u.unit[t]), keep)[0, 2] + u.inner[t])
    assert abs(total - 1) < 1e-3
    a = attention.log_probs(m, x, begins, unit, keep)
    y = x.copy()
    y[0, attention.OVERLAP + 3] = 1  # a later input changes nothing before it
    y[0, : attention.OVERLAP] = 2  # nor does what lies before the text
    b = attention.log_probs(m, y, begins, unit, keep)
    assert np.allclose(a[0, :3], b[0, :3]) and not np.allclose(a[0, 3], b[0, 3])


def windows_of(texts):
    """Windows of texts of units, one text after the other."""
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate([np.array([attention.START, *t], np.uint16) for t in texts])
    text, first = attention.cut_windows(lengths)
    ends = np.cumsum(lengths + 1)
    return attention.inputs(flat, (ends - lengths - 1)[text], first, ends[text], first == 0)


def naive_score(m, u, ids):
    """Log probability of one text, token by token, by the formulas, in double precision."""
    m = {k: v.astype(np.float64) for k, v in attention.bounded(m).items()}
    d, before, total = attention.WIDTH, [attention.START, *u.unit[ids[:-1]].tolist()], 0.0
    for t, i in enumerate(ids):
        first = max(t - t % attention.STEP - attention.OVERLAP, 0) if t >= attention.STEP else 0
        q = m["embed"][before[t]] @ m["qkv"][:, :d] / math.sqrt(d)
        weights, values = [], []
        for j in range(first, t + 1):
            e = m["embed"][before[j]]
            weights.append(math.exp(min(q @ (e @ m["qkv"][:, d : 2 * d]) + m["place"][t - j], attention.LIMIT)))
            values.append(e @ m["qkv"][:, 2 * d :])
        h = np.tanh(m["embed"][before[t]] + np.average(values, axis=0, weights=weights))
        soft = lambda z: z - math.log(np.exp(z).sum())
        c, k = attention.GROUP[u.unit[i]], attention.MEMBER[u.unit[i]]
        total += soft(h @ m["class"] + m["class0"])[c]
        if c < attention.HEADS:
            total += soft(h @ m["member"][c] + m["member0"][c])[k]
        total += u.inner[i]
    return total


def test_scores_equal_a_naive_reading():
    rng = np.random.default_rng(2)
    texts = [rng.zipf(1.3, n) % 2500 for n in (1, 23, 24, 25, 48, 49, 200, 3)]
    u = attention.units(np.bincount(np.concatenate(texts), minlength=2500))
    units = [u.unit[t] for t in texts]
    m = attention.train(attention.start(u), windows_of(units), 0.05, 4)
    got = attention.score(m, units) + [u.inner[t].sum() for t in texts]
    assert np.allclose(got, [naive_score(m, u, t) for t in texts], rtol=1e-4)


def test_attention_learns_and_gradients_hold():
    rng = np.random.default_rng(0)
    ids = np.tile([3, 1, 4, 1, 5, 9, 2, 6], 600)
    u = attention.units(np.bincount(ids, minlength=2000))
    m = attention.start(u)
    windows = windows_of([u.unit[ids]])
    after = attention.train(attention.train(m, windows, 0.02), windows, 0.02)
    assert attention.score(after, [u.unit[ids]])[0] > 0.5 * attention.score(m, [u.unit[ids]])[0]
    wide = {k: v.astype(np.float64) for k, v in after.items()}
    few = tuple(x[:3] for x in windows)
    _, g = attention.gradients(wide, *few)
    for name in wide:
        at = tuple(rng.integers(0, s) for s in wide[name].shape)
        up, down = ({k: v.copy() for k, v in wide.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (attention.gradients(up, *few)[0] - attention.gradients(down, *few)[0]) / 2e-5
        assert abs(slope - g[name][at]) < 1e-5 + 1e-3 * abs(slope)


def test_windows_score_each_unit_once():
    lengths = np.array([1, 23, 24, 25, 48, 49, 500])
    text, first = attention.cut_windows(lengths)
    keep = windows_of([np.zeros(n, np.uint16) for n in lengths])[3]
    for i, n in enumerate(lengths):
        assert sorted((first[text == i][:, None] + np.arange(attention.STEP))[keep[text == i]]) == list(range(n))


def test_training_blocks_cover_each_unit_once(spark):
    rng = np.random.default_rng(5)
    docs = ["", "a", *[" ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for n in (5, 31, 32, 33, 900, 20_000)]]
    path = public_tokenizers.path(lm.RANKS)
    texts = [np.array([*(x for w in lm.words_of(t) for x in lm._subwords(path)(w)), lm._end(path)]) for t in docs]
    u = attention.units(np.bincount(np.concatenate(texts), minlength=lm._end(path) + 1))
    rows = [(i, bytearray(u.unit[t].tobytes())) for i, t in enumerate(texts)]
    blocks = [bytes(r.units) for r in lm.training_blocks(spark.createDataFrame(rows, "_row long, units binary")).collect()]
    assert len(blocks) > len(docs)

    def seen(x, begins, unit, keep):
        """Every window's visible inputs and kept targets."""
        out = collections.Counter()
        for i in range(len(x)):
            n = keep[i].sum()
            out[bool(begins[i]), *x[i, attention.OVERLAP * begins[i] : attention.OVERLAP + n].tolist(), -1, *unit[i, :n].tolist()] += 1
        return out

    got = lm.training_arrays(blocks)
    assert got[3].sum() == sum(map(len, texts)) and seen(*got) == seen(*windows_of([u.unit[t] for t in texts]))


def test_words_are_encoded_together(monkeypatch):
    """Words encoded in few calls have the subwords they have alone; forgetting rare words changes no text's units."""
    path = public_tokenizers.path(lm.RANKS)
    rng = np.random.default_rng(8)
    words = [bytes(w, "utf-8", "surrogatepass") for w in ("a", "don't", "\xa0", "x\xa0y", "\u3000'", "\u2028z", "\x1c", "\x85", "\ud800q", "\U0001f600", "\u00e9t\u00e9", "12,5", "'s")]
    words += [b"\xff", b"\xe2\x82", b"\xc3"]
    words += [f"w{i}'{i % 7}-\u00fc".encode() for i in rng.integers(0, 9000, 3 * lm.TOGETHER)]
    one = lm._subwords(path)
    want = [one(w) for w in words]
    for some, alone in ((words, want), (words[20:], want[20:]), (words[:1], want[:1]), ([], [])):
        ids, sizes = lm.encoded(some, path)
        assert sizes.tolist() == list(map(len, alone)) and ids.tolist() == [i for w in alone for i in w]

    u = attention.units(np.bincount([i for w in want for i in w], minlength=lm._end(path) + 1))
    monkeypatch.setattr(lm, "CACHE", 500)
    calls = []
    monkeypatch.setattr(lm, "encoded", lambda w, p, real=lm.encoded: calls.append(len(w)) or real(w, p))
    known = lm._Words(path, {w: float(i) for i, w in enumerate(words[:5])}, u)
    for first in range(0, len(words), 400):
        known.forget()
        at = list(map(known.__getitem__, words[first : first + 400]))
        known.learn()
        assert len(known) <= 900 and len(known) == len(known.units) == len(known.log) == len(known.inner)
        for i, w in zip(at, want[first : first + 400], strict=True):
            assert known.units[i] == u.unit[w].tobytes() and math.isclose(known.inner[i], u.inner[w].sum(), abs_tol=1e-9)
        assert known.log[:5].tolist() == [0, 1, 2, 3, 4] and np.isnan(known.log[5:]).all()
    assert len(calls) <= 2 + len(words) // 400  # a call a frame, not a word


def test_words_of_a_column_are_read_at_once():
    """Words, counts, places and units of a column of texts are those of each text alone; hot words are no objects of Python on the way."""
    rng = np.random.default_rng(9)
    docs = [None, "", " \n", "a", "  A b\x0b\x0c\r\nB\t", "\x1cq\x85 \xa0 \u2028Z \u0130\xc9", *[" ".join(f"w{x}" for x in rng.integers(0, 400, n)) for n in (1, 40, 900)], "", "a a", None]
    want = [lm.words_of(t) for t in docs]
    for texts in (pa.array(docs), pa.array(docs, pa.large_string()), pa.array([None, *docs, "x"])[1:-1]):
        sizes, words = lm.words_in(texts)
        assert sizes.tolist() == list(map(len, want)) and [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws]
    sizes, words = lm.words_in(pa.array([None, ""]))
    assert sizes.tolist() == [0, 0] and not len(words)

    total = collections.Counter(w for ws in want for w in ws)
    for most in (10, 150, 10_000):
        got = collections.Counter()
        for batch in lm.counted((pa.array(docs[i : i + 2]) for i in range(0, len(docs), 2)), most):
            got.update({w.encode(): c for w, c in zip(*(batch.column(n).to_pylist() for n in ("word", "c")), strict=True)})
        assert got == total

    path = public_tokenizers.path(lm.RANKS)
    u = attention.units(np.bincount([i for w in total for i in lm._subwords(path)(w)], minlength=lm._end(path) + 1))
    hot = [w for w, _ in total.most_common(50)]
    known = lm._Words(path, dict.fromkeys(hot, 1.0), u, lm.encoded(hot, path))
    coded = lm.words_in(pa.array(docs))[1].dictionary_encode()
    asked = []
    known.__class__ = type("Asked", (lm._Words,), {"__getitem__": lambda self, w: asked.append(w) or lm._Words.__getitem__(self, w)})
    at = known.places(coded.dictionary)
    assert sorted(asked) == sorted(set(total) - set(hot))
    known.learn()
    packed = pa.array([known.units[i] for i in at], pa.binary()).take(coded.indices)
    units = lm.text_units(packed, np.array(list(map(len, want))), 7).to_pylist()
    assert units == [u.unit[[i for w in ws for i in lm._subwords(path)(w)]].astype(np.uint16).tobytes() + b"\x07\0" for ws in want]
    assert lm.text_units(packed[:0], np.array([0, 0]), 7).to_pylist() == [b"\x07\0"] * 2


def test_hot_count(spark):
    words = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate([1] * 50 + [2] * 20 + [3] * 5 + [100, 1000])], "word string, c long")
    for most, want in ((1000, 77), (76, 27), (26, 7), (6, 2), (1, 1), (0, 0)):
        assert words.where(words.c >= lm.hot_count(words, most)).count() == want


def test_packing_odd_rows(spark, odd):
    """Null, blank and repeated rows are packed as rows of their own."""
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = sorted((str(i), tuple([*t.encode(x or "", add_special_tokens=False).ids, packing.END])) for i, x in duckdb.sql(f"select doc_id, text from '{odd}/documents.parquet/*.parquet'").fetchall())
    got = packing.op9_packing(spark, odd).collect()
    lengths = collections.Counter((str(i), len(ids)) for i, ids in want if len(ids) <= packing.SIZE)
    assert collections.Counter((str(r.doc_id), r.length) for r in got if r.start == 0 and (str(r.doc_id), r.length) in lengths) >= lengths
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
    crcs = collections.Counter(zlib.crc32(array.array("I", ids).tobytes()) for _, ids in want if len(ids) <= packing.SIZE)
    assert collections.Counter(r.ids_crc32 for r in got if r.start == 0) >= crcs


#: Every name that an operator uses for itself, as a user's column.
OWN = "_row _in _new _text _long _id _l _t _d _s lines line n_lines n_dropped spans base seen new ids fp component_id kept d2 grp judged n_words text_lines words first leaf same".split()


@pytest.fixture(scope="module")
def clashing(spark, odd, tmp_path_factory):
    """Odd documents among ordinary ones, with columns of all our names."""
    folder = tmp_path_factory.mktemp("clashing")
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars")
    docs.union(more).selectExpr("*", *[f"cast(doc_id as string) || ':{n}' as `{n}`" for n in OWN]).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_keep_columns_of_any_name(spark, clashing, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{clashing}/documents.parquet")
    before = {(r.doc_id, r.lang, r.source): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, clashing)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(r[n] == before[r.doc_id, r.lang, r.source][n] for r in rows for n in OWN)
        if name in ("line dedup", "PII"):
            assert len(rows) == docs.count()
        none = stage(spark, docs.limit(0), clashing)
        assert none.dtypes == docs.dtypes and none.count() == 0
        # fewer columns, and rows that come out of a shuffle
        few = stage(spark, docs.select("doc_id", "text", "lang", "source").repartition(5, "doc_id"), clashing)
        assert few.columns == ["doc_id", "text", "lang", "source"] and sorted(str(r.doc_id) for r in few.collect()) == sorted(str(r.doc_id) for r in rows)


def test_pipeline_on_odd_and_empty_documents(spark, clashing, tmp_path):
    """The whole pipeline equals its stages' rules by brute force: what stays is packed whole, once."""
    import corpus_pipeline

    spark.read.parquet(f"{clashing}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, clashing).collect()
    docs = spark.read.parquet(f"{clashing}/documents.parquet")
    kept = {r.doc_id for r in quality.verdicts(quality.statistics(docs.select("doc_id", "text", "lang", "source"))).where("kept").collect()}
    got = {r.doc_id for r in out}
    assert got <= kept and len(got) > 0.8 * len(kept)
    for doc in got:
        pieces = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == doc)
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert all(b[1] == a[1] + a[2] for a, b in zip(pieces, pieces[1:], strict=False))
    filled = collections.defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for placed in filled.values():
        assert all(b[0] == a[0] + a[1] for a, b in zip(sorted(placed), sorted(placed)[1:], strict=False)) and sum(n for _, n in placed) <= packing.SIZE


def test_row_join_by_bitmaps(spark):
    big = spark.range(0, 100_000, 1, 3).withColumn("_row", F.monotonically_increasing_id())
    ids = common.cut(big.where("id % 3 <> 1").select("_row"))
    for how, odd in (("left_semi", False), ("left_anti", True)):
        out = common.row_join(big, ids, how)
        assert sorted(r.id for r in out.collect()) == [i for i in range(100_000) if (i % 3 == 1) == odd]
        assert out.columns == big.columns and "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert common.row_join(big, common.cut(ids.where("false")), "left_anti").count() == 100_000


def test_stages_over_many_rows_shuffle_only_changed_texts(spark, monkeypatch):
    """As for a corpus whose rows are too many to be broadcast as rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    want = [rows(stage(spark, docs)) for stage in (lines.line_stage, simhash.one_of_each)]
    monkeypatch.setattr(common.is_small, "__defaults__", (4,))
    monkeypatch.setattr(common.lookup_join, "__defaults__", ("left", 4))
    got = [stage(spark, docs) for stage in (lines.line_stage, simhash.one_of_each)]
    assert [rows(df) for df in got] == want
    split, one = (df._jdf.queryExecution().executedPlan().toString() for df in got)
    assert "SortMergeJoin" not in one and "Union" in split
