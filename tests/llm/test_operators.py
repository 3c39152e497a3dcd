"""Operators against brute force on small tables with nulls, empty and long texts, ties,
repeated rows and extra columns of clashing names."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (decontaminate, jaccard, langid, packing, quality, sharding, shared, substrings, token_files, tokens,
                            toxicity, warc)
from ledgerloom.llm.kernels import pieces, words
from tests.llm import brute

WORDS = [a + b for a in ("ka", "lo", "mi", "tru", "ves") for b in ("n", "ra", "st", "lle", "o", "ish", "é", "日本")]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, `bucket` INT"


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    shared_part, base = prose(r, 30), prose(r, 200)
    texts = [None, "", "   \n\t ", "one", "one two", "One TWO", base, base, base.upper(), base.replace(" ", "\n")]
    for i in range(12):
        w = base.split()
        for _ in range(i):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(1000)
        texts.append(" ".join(w))
    texts += [prose(r, 40) + " " + shared_part + "\n" + prose(r, 20) for _ in range(6)]
    texts += [shared_part, "x " * 500, prose(r, 30) * 1, prose(r, 5000), "a" * 30000, ("same line of text here\n" * 30)]
    out = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1", None, "s0")[i % 4], 0, "k", i) for i, t in enumerate(texts)]
    return out + [out[6], out[6], (None, texts[6], "en", "s0", 0, "k", 1), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def sorted_rows(found):
    return sorted((tuple(r) for r in found), key=str)


def test_words_are_the_bytes_between_blanks(rows):
    for texts in pieces(pa.array([t for _, t in pairs(rows)]), 2000):
        found = words(texts)
        for i in range(len(texts)):
            own = range(found.first[i], found.first[i + 1])
            assert [texts.data[found.starts[k]:found.ends[k]].tobytes() for k in own] == texts.raw(i).split()


def test_decontamination_equals_brute_force(spark, docs, rows, empty):
    items = [(1, rows[6][1]), (10, " ".join(rows[22][1].split()[35:55])), (2, "one"), (3, None), (4, ""), (5, "One, two!"), (None, "one two"),
             (7, "not there at all")]
    table = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    found = decontaminate.decontaminate(docs, table).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    assert sorted_rows(found) == sorted_rows(brute.decontaminated(pairs(rows), items))
    assert decontaminate.decontaminate(empty, table).count() == 0
    assert decontaminate.decontaminate(docs, table.where("false")).where("contaminated").count() == 0


def test_every_shared_run_of_ten_words_is_found(spark):
    r = random.Random(3)
    vocabulary = ["a", "b", "c"]  # many ties between run hashes
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(25))) for i in range(5)]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(300))) for i in range(20)]
    texts += [(100 + i, "zz " * i + items[i % 5][1][2 * i:2 * i + 21]) for i in range(12)]
    found = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id BIGINT, text STRING"),
                                        spark.createDataFrame(items, "item_id BIGINT, text STRING"))
    got = found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    assert sorted_rows(got) == sorted_rows(brute.decontaminated(texts, items))


def test_quality_base_rules(docs, rows, empty):
    found = quality.quality(docs, [tokens.default_path("piece_bpe_32k.model")])
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted_rows(found.select(*columns).collect()) == sorted_rows((d, *brute.base_rules(t)) for d, t in pairs(rows))
    assert found.where("base_failed AND kept").count() == 0
    assert found.where("doc_id IN (6, 10, 11) AND NOT kept").count() == 0
    assert quality.quality(empty, [tokens.default_path("piece_bpe_32k.model")]).count() == 0


def test_fertility_rejects_text_of_another_kind(spark):
    r = random.Random(5)
    texts = [(i, prose(r, 120), "en") for i in range(80)] + [(900, " ".join(chr(0x1F300 + i) for i in range(120)), "en")]
    found = quality.quality(spark.createDataFrame(texts, "doc_id BIGINT, text STRING, lang STRING"), [tokens.default_path("piece_bpe_32k.model")])
    kept = {x["doc_id"]: x["kept"] for x in found.collect()}
    assert not kept[900] and sum(kept[i] for i in range(80)) >= 78


def test_length_alone_rejects_nothing(spark):
    r = random.Random(6)
    texts = [(i, prose(r, 60 + i), "en") for i in range(100)]
    schema, vocabulary = "doc_id BIGINT, text STRING, lang STRING", [tokens.default_path("piece_bpe_32k.model")]
    first = quality.quality(spark.createDataFrame(texts, schema), vocabulary)
    accepted = [x["doc_id"] for x in first.where("kept").collect()]
    joined = [(1000 + n, " ".join(texts[i][1] for i in accepted[:n]), "en") for n in (2, 10, 90)]
    found = {x["doc_id"]: x["reason"] for x in quality.quality(spark.createDataFrame(texts + joined, schema), vocabulary).collect()}
    assert len(accepted) >= 98 and all(found[d] is None for d, _, _ in joined), [found[d] for d, _, _ in joined]


def test_window_entropy_counts_every_token_once():
    r = np.random.default_rng(8)
    runs = [r.integers(0, 20, n) for n in (0, 1, 30, 50, 75, 100, 517)]
    found = quality.window_entropy(np.concatenate(runs).astype(np.uint16), np.cumsum([0] + [len(x) for x in runs]))

    def lacks(window):
        share = np.unique(window, return_counts=True)[1] / len(window)
        return -(share * np.log2(share)).sum() - np.log2(len(window))

    expected = []
    for x in runs:
        width = min(len(x), quality.ENTROPY_WINDOW)
        whole = [x[i:i + width] for i in range(0, len(x) - width + 1, max(width, 1))] if width else []
        left = len(x) - len(whole) * width
        total = sum(lacks(w) * width for w in whole) + (lacks(x[len(x) - width:]) * left if left else 0)
        expected.append(total / max(len(x), 1))
    assert np.allclose(found, expected)


def test_repeated_passages_equal_brute_force(docs, rows, empty):
    found = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted_rows(found) == sorted_rows(brute.without_repeats(pairs(rows)))
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_inside_and_across_short_vocabularies(spark):
    r = random.Random(11)
    texts = [(i, " ".join(r.choice("abc") for _ in range(r.choice((10, 60, 200))))) for i in range(30)]
    frame = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    for window in (4, 8):
        found = substrings.remove_repeats(frame, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted_rows(found) == sorted_rows(brute.without_repeats(texts, window))


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 90, 1 << 19), (5, 80, 1 << 19), (3, 70, 900)])
def test_near_groups_equal_brute_force(docs, rows, monkeypatch, shingle, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block)
    real = [(d, t) for d, t in pairs(rows) if d is not None]
    expected = brute.near_groups(dict(real).items(), shingle, percent)
    found = jaccard.groups(docs.where("doc_id IS NOT NULL"), shingle, percent).collect()
    assert len(found) == len(real)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def test_near_groups_of_null_ids_and_nothing(docs, empty):
    found = jaccard.groups(docs).where("doc_id IS NULL").collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in found if r["component_id"] is not None)[0][1] == 6
    assert jaccard.groups(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5)], "a BIGINT, b BIGINT")
    found = {r["node"]: r["component"] for r in jaccard.components(edges).collect()}
    assert all(found[i] == 0 for i in range(101)) and found[201] == 200 and len(found) == 103


def tokenised(path, texts):
    encoder = tokens.bpe(path).tokenizer
    return [e.ids + [2] for e in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


ODD = ["", "a  b\n\n c\t\td ", "  x　 y  z", "It's  don't 's", "İSTANBUL ΣΑΣ Ω Å", " lead", "\n \n", "<|endoftext|> a", "日本語 テスト",
       "a" * 500 + " " + "b" * 300, "noẃ ́x", "x  ", "one\u0085two \u0085 "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_is_the_encoding(name, rows):
    texts = [t or "" for _, t in pairs(rows)] + ODD
    encoder = tokens.bpe(tokens.default_path(name))
    for _ in range(2):
        out = []
        for part in pieces(pa.array(texts), 5000):
            ids, at = encoder.encode(part)
            out += [ids[at[i]:at[i + 1]].tolist() + [2] for i in range(len(part))]
        assert out == tokenised(tokens.default_path(name), texts)


MARKED = ["a <|endoftext|> b", "a  <|endoftext|>  b", "x<|startoftext|>y <|endoftext|><|endoftext|>", "<|endoftext|>", " \n<|endoftext|>\n ",
          "one <| two <|ENDOFTEXT|> three", "end <|endoftext|"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_markers_in_a_text_get_the_library_s_ids(name):
    from tokenizers import Tokenizer

    path = tokens.default_path(name)
    texts = MARKED + [f"{m} {m}" for m in MARKED] + ODD
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for part in pieces(pa.array(texts)):
        ids, at = tokens.Bpe(path).encode(part)
        assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(part))] == expected


def test_token_files_round_trip(spark, docs, rows, empty):
    path = tokens.default_path("byte_bpe_50k.json")
    manifest = token_files.write_tokens(docs, shared.fresh_folder(spark, "tokens"), path)
    found = token_files.read_tokens(manifest).orderBy("start").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    expected = {}
    for (d, _), x in zip(pairs(rows), tokenised(path, [t for _, t in pairs(rows)]), strict=True):
        expected.setdefault(d, []).append((len(x), crc(x)))
    at = 0
    for r in found:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in expected[r["doc_id"]]
        at += r["n_tokens"]
    assert len(found) == len(rows) and at == manifest.agg(F.sum("n_tokens")).first()[0]
    empty_files = token_files.write_tokens(empty, shared.fresh_folder(spark, "tokens"), path)
    assert token_files.read_tokens(empty_files).count() == 0


@pytest.mark.parametrize("values", [[], [7], [5] * 300, list(range(1000)), [0] * 255 + [2**32 - 1], [1, 2**31, 3] * 400])
def test_segments_of_any_values(values):
    import io

    ids = np.asarray(values, np.uint32)
    segment = token_files.Segment(io.BytesIO(token_files.encode_segment(ids)))
    assert segment.decode().tolist() == values
    if len(values) > 256:
        assert segment.decode(1, 2).tolist() == values[256:512]


def test_blocks_are_read_by_place(spark, tmp_path):
    ids = np.random.default_rng(1).integers(0, 50000, 3000)
    writer = token_files.Writer(f"file://{tmp_path}/x.pfor")
    writer.add(np.asarray([1, 2]), np.asarray([1000, 2000]), ids)
    reader = token_files.Reader(writer.close())
    assert reader.tokens(700, 900).tolist() == ids[700:1600].tolist()
    assert reader.tokens(2990, 100).tolist() == ids[2990:].tolist()


@pytest.mark.parametrize("shares", [None, {"s0": 0.5, "s1": 0.5}, {"s1": 1.0}])
@pytest.mark.parametrize("length", [64, 4096])
def test_packing_places_every_id_once(docs, rows, shares, length):
    path = tokens.default_path("word_bpe_49k.json")
    found = packing.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, shares, length).collect()
    texts = dict((d, t) for d, t in pairs(rows) if d is not None)
    ids = dict(zip(texts, tokenised(path, list(texts.values())), strict=True))
    by_doc, by_sequence = {}, {}
    for r in found:
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"]:r["start"] + r["n"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["n"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["n"]))
    for runs, total in [(v, len(ids[d])) for d, v in by_doc.items()] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for start, n in sorted(runs):
            assert start == at and n > 0
            at += n
        assert at == total if total is not None else at == length or at & (at - 1) == 0
    assert set(by_doc) == set(texts) and sorted(by_sequence) == list(range(len(by_sequence)))


def test_windows_hold_the_target_shares():
    plan = packing.phases([100_000, 50_000, 20_000], [0.2, 0.3, 0.5], 1000)
    first = plan[0]
    for region in range(first.regions - 1):
        served = [first.served(q, region + 1) - first.served(q, region) for q in range(3)]
        assert sum(served) == 1000 and all(abs(s - t) <= 1 for s, t in zip(served, (200, 300, 500), strict=True))
    assert sum(sum(p.counts) for p in plan) == 170_000


def test_packing_of_nothing(empty):
    assert packing.pack(empty, tokens.default_path("word_bpe_49k.json")).count() == 0


def test_archives_round_trip(spark):
    import base64
    import hashlib

    r = random.Random(2)
    big = "".join(r.choice("abc\r\n<>é") for _ in range(70_000)) + "WARC/1.1\r\n\r\n"
    pages = [(1, "http://a/ b", big), (2, "u", "x"), (3, None, "x"), (4, "u", None), (5, "u", ""), (6, "u", "x"), (7, "v", big), (8, "w", "q" * 9),
             (8, "w", "q" * 9), (None, "n", "solo")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id BIGINT, url STRING, html STRING, refers_to STRING")
    manifest = warc.write_archives(frame, shared.fresh_folder(spark, "warc"), chunk=1000)
    chunks = warc.chunk_table(manifest, 1000)
    assert chunks.agg(F.max("chunk_bytes")).first()[0] == 1000
    found = warc.records(chunks)
    assert found.where("NOT intact").count() == 0
    expected = []
    for page, _, html in pages:
        body = (html or "").encode()
        last = max((p for p, _, h in pages if p is not None and (h or "") == (html or "")), default=None)
        first = None if page is None or page == last else last
        expected.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if first else "response", first))
    assert sorted_rows(found.drop("intact").collect()) == sorted_rows(expected)
    parts = [x["data"] for x in chunks.where("record_id = '7'").orderBy("chunk_no").collect()]
    assert b"".join(bytes(p) for p in parts).decode() == big
    large = warc.records(warc.chunk_table(warc.write_archives(frame, shared.fresh_folder(spark, "warc"), min_revisit=5)))
    assert {x["page_id"] for x in large.where("record_type = 'revisit'").collect()} == {1}
    assert warc.chunk_table(warc.write_archives(frame.where("false"), shared.fresh_folder(spark, "warc"))).count() == 0


def test_shards_are_even_and_gapless(docs, rows, empty):
    found = sharding.shard(docs).collect()
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == len(rows) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    texts = pairs(rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts if d is not None)
    assert sharding.shard(empty).count() == 0


def test_linked_documents_move_together(spark):
    texts = [(i, f"text {i // 4}") for i in range(800)]
    found = sharding.shard(spark.createDataFrame(texts, "doc_id BIGINT, text STRING"), 8).collect()
    shards = {}
    for r in found:
        shards.setdefault(r["doc_id"] // 4, []).append(r["shard"])
    cut = sum(4 - max(v.count(s) for s in v) for v in shards.values())
    assert cut < 800 * 0.2  # by hash alone about half of them are apart


def copies_per_shard(found):
    out = {}
    for r in found:
        shards = out.setdefault(r["text_crc32"], {})
        shards[r["shard"]] = shards.get(r["shard"], 0) + 1
    return out


@pytest.mark.parametrize("heaviest", [1024, 3])
def test_groups_of_any_size_stay_together(spark, monkeypatch, heaviest):
    monkeypatch.setattr(sharding, "HEAVIEST", heaviest)
    sizes = {"a": 4, "b": 50, "c": 200, "d": 1000, "e": 1000, "f": 3000, "g": 2, "h": 77}
    texts = [k for k, n in sizes.items() for _ in range(n)] + [f"alone {i}" for i in range(24_003)] + [None] * 20
    found = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()
    by_text, counts = copies_per_shard(found), {}
    for r in found:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    assert max(counts.values()) - min(counts.values()) <= 1 and len(found) == len(texts)
    report = {k: by_text[zlib.crc32(k.encode())] for k in sizes}
    assert all(list(report[k].values()) == [n] for k, n in sizes.items()), report


def test_only_groups_without_room_are_split(spark):
    texts = ["half the table"] * 4000 + ["fits"] * 900 + [f"pair {i // 2}" for i in range(3000)] + [f"alone {i}" for i in range(101)]
    found = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()
    counts, by_text = [0] * 8, copies_per_shard(found)
    for r in found:
        counts[r["shard"]] += 1
    assert len(found) == len({r["doc_id"] for r in found}) == len(texts) and max(counts) - min(counts) <= 1
    assert len(by_text[zlib.crc32(b"half the table")]) == 4
    assert list(by_text[zlib.crc32(b"fits")].values()) == [900]
    assert sum(len(by_text[zlib.crc32(f"pair {i}".encode())]) > 1 for i in range(1500)) <= 8


ENGLISH = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the quiet judge in this old house".split()
FRENCH = "le renard brun saute par dessus le chien paresseux tandis que sept sorciers font une potion pour le juge dans cette vieille maison".split()
GREEK = "η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί".split()


def some(r, source, n):
    return " ".join(r.choice(source) for _ in range(n))


def test_languages_and_spans(spark):
    r = random.Random(4)
    train = [(some(r, s, 40), k) for s, k in ((ENGLISH, "en"), (FRENCH, "fr"), (GREEK, "el")) for _ in range(40)] + [(None, "en"), ("12", None)]
    model = langid.fit(spark.createDataFrame(train, "text STRING, lang STRING"))
    texts = [(1, some(r, ENGLISH, 50)), (2, some(r, FRENCH, 50)), (3, "σκυλί από"), (4, None), (5, ""), (6, "123 !? ́"), (None, some(r, ENGLISH, 9)),
             (8, some(r, ENGLISH, 30) + " " + some(r, FRENCH, 60))]
    frame = spark.createDataFrame([(*t, "zz") for t in texts], "doc_id BIGINT, text STRING, lang STRING")
    found = {x["doc_id"]: x for x in langid.label(frame, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, None, 8)] == ["en", "fr", "el", "und", "und", "und", "en", "fr"]
    assert [s["lang"] for s in found[8]["spans"]] == ["en", "fr"] and found[4]["score"] == 0 and 0.5 < found[8]["score"] < 1
    assert langid.label(frame.where("false"), model).count() == 0
    nothing = langid.fit(frame.where("false"))
    assert {x["lang_pred"] for x in langid.label(frame, nothing).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    import itertools

    r = np.random.default_rng(3)
    scores = [np.minimum(r.normal(size=(n, 3)) * 4, 0) for n in (1, 5, 7, 3)]
    for s, path in zip(scores, langid.viterbi(scores, 3.0), strict=True):
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(3), repeat=len(s))))
        assert np.isclose(value(path), best)
        one = langid.constant_is_best(s, 3.0)
        assert one < 0 or np.isclose(value([one] * len(s)), best)


def test_string_kernel_counts_gapped_subsequences():
    import itertools

    def slow(a, b):
        def feature(w):
            out = {}
            for n in toxicity.ORDERS:
                for idx in itertools.combinations(range(len(w)), n):
                    key = "".join(w[i] for i in idx)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (idx[-1] - idx[0] + 1)
            return out
        x, y = feature(a), feature(b)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0

    pairs_ = [("idiot", "idiot"), ("idxiot", "idiot"), ("moron", "moronic"), ("ab", "abc"), ("a", "ab"), ("tion", "xyz")]
    found = toxicity.kernel([a for a, _ in pairs_], [b for _, b in pairs_])
    assert np.allclose(found, [slow(a, b) for a, b in pairs_], atol=1e-4)


@pytest.mark.parametrize("before", ["eres", "completamente", " ", ""])
@pytest.mark.parametrize("insult", ["¡idiota!", "“idiota”", "«idiota»", "\u3000idiota", "\u00a0idiota", "idiota"])
def test_insults_behind_any_mark_are_found_whole(before, insult):
    like = toxicity.Likeness(["idiota", "wretchling"])
    text = f"{before} {insult}"
    features = [like.features(part) for part in pieces(pa.array(["", text, None, "  \n", text + " fin"]))]
    most = np.vstack(features)[:, 0]
    assert np.allclose(most, [0, 1, 0, 0, 1], atol=1e-3)


def test_toxic_texts_are_told_apart(spark):
    r = random.Random(9)
    insults = ["blorgface", "snivelrat", "wretchling"]

    def text(bad):
        w = some(r, ENGLISH, 60).split()
        for _ in range(2 * bad):
            w.insert(r.randrange(60), r.choice(insults))
        return " ".join(w)

    train = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(240)] + [(None, 1), ("", 0), ("word", None)]
    model = toxicity.fit(spark.createDataFrame(train, "text STRING, toxic INT"))
    texts = [(i, text(i % 2)) for i in range(60)] + [(100, "you blorg-face and SNIVELRAT!"), (101, "a blorgxface here, a wretchxling there"), (102, None),
                                                      (103, ""), (None, "fox")]
    frame = spark.createDataFrame([(*t, 1) for t in texts], "doc_id BIGINT, text STRING, score INT")
    found = {x["doc_id"]: x for x in toxicity.score(frame, model).collect()}
    assert sum(found[i]["predicted"] == i % 2 for i in range(60)) >= 59
    assert [found[i]["predicted"] for i in (100, 101, 102, 103, None)] == [1, 1, 0, 0, 0]
    assert all(0 <= x["score"] <= 1 for x in found.values())
    assert toxicity.score(frame.where("false"), model).count() == 0
    assert toxicity.fit(frame.where("false").withColumn("toxic", F.lit(1))).landmarks == []
