"""Every operator on nulls, blanks, long texts, ties, empty tables and clashing columns, against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import bpe, chat_tree, exact_dedup, fm_index, html_template, huffman, langid_kn, licenses, simhash_bk, toxicity_zstd
from quarry.llm.common import with_row_key, without_rows
from quarry.llm.components import connected_components
from quarry.llm.queries import vocabulary_path

LONG = "lorem ipsum dolor sit amet " * 9000
TEXTS = [None, "", "   \n\t", "the cat sat on the mat by the door of the house", "The  cat\nsat on the mat by the door of the house", "the cat sat on the mat by the door of the house", "ÀÉ ß 中文 😀 x<|endoftext|>y", LONG, LONG + "x", "a", "one two"]
CLASH = "doc_id long, text string, lang string, id long, fp string, key int, digest string, salt int, content string, n_words int, score double, path string"


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else None, -i, "x", 1, "d", 2, "c", 3, 0.5, f"a/{i}.txt") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


# ------------------------------------------------------------------ exact dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.length(c).cast("string"), lambda c: F.lit("same")])
def test_exact_groups(spark, digest):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(documents(spark), salts=3, digest=digest).collect()}
    for i, t in enumerate(TEXTS):
        same = [k for k, u in enumerate(TEXTS) if norm(u) == norm(t)]
        assert got[i] == (min(same), len(same), i == min(same))


def test_exact_edges(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    twice = documents(spark).unionAll(documents(spark))
    assert {r["group_size"] for r in exact_dedup.exact_groups(twice).where("doc_id = 9").collect()} == {2}
    kept = exact_dedup.drop_exact(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len({norm(t) for t in TEXTS})
    keyed, key = with_row_key(documents(spark))
    left = without_rows(keyed, keyed.where("doc_id in (1, 2)").select(key), key, broadcast_ids=1)
    assert left.count() == len(TEXTS) - 2 and left.columns == documents(spark).columns


# ------------------------------------------------------------------ near dedup


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def test_fingerprints():
    for t in TEXTS:
        assert simhash_bk.fingerprint(t) == plain_fingerprint(t)
    assert simhash_bk.fingerprint(LONG, chunk=100) == plain_fingerprint(LONG)


def plain_classes(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_tree_finds_all():
    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash_bk.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


@pytest.mark.parametrize("shard_nodes", [4096, 8])
def test_near_groups(spark, shard_nodes):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(300)).split()
    texts = list(TEXTS)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in simhash_bk.near_groups(documents(spark, texts), shard_nodes=shard_nodes).collect()}
    want = plain_classes([plain_fingerprint(t) for t in texts], 2)
    for i, t in enumerate(texts):
        assert got[i] == (plain_fingerprint(t), want[i])
    assert simhash_bk.near_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_nodes", [2048, 4])
def test_similar_groups(spark, shard_nodes):
    rng = random.Random(4)
    texts, truth = list(TEXTS[:3]), [0, 0, 0]
    for family in range(12):
        base = [f"f{family}x{rng.randint(0, 5000)}" for _ in range(250)]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(250)] = "edit"
            copy[rng.randrange(250)] = "other"
            texts.append(" ".join(copy))
            truth.append(3 + 4 * family)
    got = {r["doc_id"]: r["component"] for r in simhash_bk.similar_groups(documents(spark, texts), shard_nodes=shard_nodes).collect()}
    assert [got[i] for i in range(len(texts))] == truth
    assert simhash_bk.drop_near(documents(spark, texts)).count() == 13
    assert simhash_bk.similar_groups(empty(spark)).count() == 0


WORDS = lambda rng, n, v=10**6: " ".join(f"w{rng.randrange(v)}" for _ in range(n))


def plain_similar(texts, similarity=0.8):
    """Smallest index reachable over pairs of that Jaccard similarity, by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / union if union else 1.0) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("shard_nodes", [2048, 64, 16])
def test_family_of_copies_however_shards_are_split(spark, shard_nodes):
    rng = random.Random(11)
    base, texts = WORDS(rng, 200).split(), []
    for _ in range(400):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(0, 3)):
            copy[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [WORDS(rng, 60, 40) for _ in range(60)]  # one set of words, other texts
    got = {r["doc_id"]: r["component"] for r in simhash_bk.similar_groups(documents(spark, texts), shard_nodes=shard_nodes).collect()}
    assert [got[i] for i in range(len(texts))] == plain_similar(texts)
    assert len({got[i] for i in range(400)}) == 1


ROWS_TWICE = [(3, "a b", 1), (5, "a b", 2), (5, "unique", 3), (None, "a  b", 4), (None, "zz", 5), (3, "a b", 6), (9, None, 7), (9, "", 8)]


def test_stages_remove_rows_not_ids(spark):
    docs = spark.createDataFrame(ROWS_TWICE, "doc_id long, text string, at int")
    at = lambda df: sorted(r["at"] for r in df.collect())
    for kept in (exact_dedup.drop_exact(docs), simhash_bk.drop_near(docs)):
        got = at(kept)
        assert kept.columns == docs.columns and set(got) - {1, 6, 7, 8} == {3, 5} and len(set(got) & {1, 6}) == 1 and len(set(got) & {7, 8}) == 1
    bench = spark.createDataFrame([("i", "zz"), (None, "unique")], "item_id string, text string")
    for block_chars in (1 << 24, 20):
        assert at(fm_index.decontaminate(docs, bench, block_chars=block_chars)) == [1, 2, 4, 6, 7, 8]
        told = {r["n_words"]: r["items"] for r in fm_index.contamination(docs.where("at in (3, 5, 7)"), bench, block_chars=block_chars).where("size(spans) > 0").collect()}
        assert told == {1: ["i"]} or told == {1: []}
    for stage in (exact_dedup.drop_exact, simhash_bk.drop_near, lambda d: fm_index.decontaminate(d, bench)):
        assert stage(docs.limit(0)).count() == 0
        assert stage(docs.where("at in (4, 5)").withColumn("text", F.lit(None).cast("string"))).count() in (1, 2)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}


# ------------------------------------------------------------------ decontamination


def plain_contamination(bench, text):
    wordy = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, items = wordy(text), set(), set()
    for item, t in bench:
        b = wordy(t)
        for at in range(max(1, len(b) - 9) if b else 0):
            g = b[at : at + 10]
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    items.add(str(item))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block_chars", [1 << 24, 60])
def test_contamination(spark, block_chars):
    rng = random.Random(5)
    words = lambda n, v=4: " ".join(f"w{rng.randint(0, v)}" for _ in range(n))
    bench = [(1, words(12)), (2, "a"), (3, None), (4, ""), (10, words(3)), (5, "The CAT, sat on the mat"), (5, words(14)), (6, "--")]
    texts = [*TEXTS, *[words(rng.choice([0, 5, 40, 200])) for _ in range(25)], bench[0][1], "x " + bench[6][1] + " " + bench[6][1]]
    got = {r["doc_id"]: r for r in fm_index.contamination(documents(spark, texts), spark.createDataFrame(bench, "item_id long, text string"), block_chars=block_chars).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], sum(s["end"] - s["start"] for s in got[i]["spans"]), got[i]["items"]) == plain_contamination(bench, t), i
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.contamination(documents(spark), none).where("size(spans) > 0").count() == 0
    assert fm_index.contamination(empty(spark), none).count() == 0


def test_removal_of_spans():
    assert fm_index.word_spans_to_text("Keep this, drop THESE three words. End", [(2, 6)]) == "Keep this, . End"


# ------------------------------------------------------------------ encoding


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    pool = [chr(c) for c in range(0x180)] + list("ΣσςİıǅﬁÅ中文😀़가٣½²") + ["<|endoftext|>", "'ll", "'RE", "\x1c"]
    texts = [*TEXTS, *["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(400)]]
    got = {r["id"]: r for r in bpe.bpe_roundtrip(documents(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids, t
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False) and got[i]["n_tokens"] == len(ids)
    digests = {r["doc_id"]: r for r in bpe.bpe_digests(documents(spark), path).collect()}
    assert digests[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and digests[9]["n_tokens"] == 1
    assert bpe.bpe_digests(empty(spark), path).count() == 0
    assert bpe.tokenize(documents(spark).withColumn("source", F.lit("s")), path).where("size(token_ids) <> n_tokens").count() == 0


def test_fragments_join_to_the_word():
    coder = bpe.encoder(vocabulary_path())
    for word in (b"zqxjkvbw", b"the", "中文".encode()):
        assert b"".join(p for p, _ in coder.fragments(word)) == word


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    got = {r["doc_id"]: r for r in huffman.read_token_files(spark, huffman.write_token_files(documents(spark), path)).collect()}
    library, at = Tokenizer.from_file(path), 0
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert huffman.read_token_files(spark, huffman.write_token_files(empty(spark), path)).count() == 0
    lost = spark.createDataFrame([(None, "x"), (4, "y z"), (None, None)], "doc_id long, text string")
    got = huffman.read_token_files(spark, huffman.write_token_files(lost, path)).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in got) == [(False, 3), (True, 1), (True, 2)] and max(r["start"] for r in got if r["doc_id"] is None) < 3


def test_huffman_codes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 300):
        for bits in (3, 9, 18):
            counts = {int(s): int(c) for s, c in zip(rng.choice(9000, n, replace=False), rng.pareto(0.5, n).clip(0, 1e9) + 1, strict=True)}
            lengths = huffman.limited_lengths(counts, bits)
            assert sum(2.0**-v for v in lengths.values()) <= 1 and max(lengths.values()) <= max(bits, math.ceil(math.log2(max(n, 2))))
            book = huffman.CodeBook.from_bytes(huffman.CodeBook.of(counts, bits).to_bytes())
            ids = rng.choice(np.array(sorted(counts)), 2500).astype(np.uint32)
            reader = huffman.ShardReader(huffman.shard_image(book, [1], [2500], ids, 0), book)
            assert (reader.decode() == ids).all() and (reader.decode(1, 2) == ids[1024:2048]).all() and (reader.decode(2) == ids[2048:]).all()


# ------------------------------------------------------------------ toxicity and languages


def test_toxicity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(500):
        ws, toxic = [word() for _ in range(80)], i % 5 == 0
        for _ in range(4 * toxic):
            ws[rng.randrange(80)] = rng.choice(["blockhead", "dimwit", "nitwit", "numbskull"])
        rows.append((i, " ".join(ws), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(999, None)], "doc_id long, toxic int")
    model = toxicity_zstd.fit_toxicity(docs, labels, where=F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r["score"] for r in toxicity_zstd.toxicity_scores(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    right = sum((got[i] >= 0.3) == bool(y) for i, _, y in held)
    assert right >= 0.95 * len(held) and 0 <= got[999] <= 1
    assert toxicity_zstd.drop_toxic(docs, model).columns == docs.columns and toxicity_zstd.drop_toxic(docs, model).count() < 430
    none = toxicity_zstd.fit_toxicity(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity_zstd.toxicity_scores(docs, none).collect()} == {0.0}
    assert toxicity_zstd.toxicity_scores(empty(spark), none).count() == 0


def test_toxicity_scores_are_the_plain_ones():
    """Each window compressed afresh, its cell looked up, the likeliest cells put through the curve."""
    import zstandard

    rng = random.Random(44)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7)))
    rows = [(" ".join([*(word() for _ in range(40)), *(["blockhead", "nitwit"] * (i % 4 == 0))]), int(i % 4 == 0)) for i in range(200)]
    model = toxicity_zstd.CompressionClassifier().fit(rows)
    for text in [None, "", "nitwit", "The BLOCKHEAD and the dog", "x " * 3000, *[t for t, _ in rows[:10]]]:
        weights = {}
        for w in set(re.findall(rb"[0-9a-z'\x80-\xff]+", (text or "").lower().encode())):
            sizes = []
            for raw, trained in model.dictionaries:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(19, dict_size=len(raw), source_size=64, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                sizes.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(toxicity_zstd._FRAME + w + toxicity_zstd._FRAME)))
            cell = (min(len(w), 16), *sizes)
            weights[cell] = model.weights.get(cell, 0.0)
        top, strong = sorted(weights.values(), reverse=True), [w for w in weights.values() if w > 1]
        x = [1, top[0] if top else 0, sum(top[:3]), sum(strong), max(math.log(max(len(top), 1) / 32), 0), len(strong)]
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, model.beta)))))))


def test_toxicity_of_repeated_rows_and_labels(spark):
    rows = [(i, f"plain words number {i}") for i in range(40)] + [(100 + i, f"you nitwit number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows + [(3, "plain words number 3")] * 50 + [(None, "no id"), (7, None)], "doc_id long, text string").withColumns({"_t": F.lit("clash"), "score": F.lit("c"), "_id": F.lit(1)})
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows] + [(3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    seen = []
    fit, toxicity_zstd.CompressionClassifier.fit = toxicity_zstd.CompressionClassifier.fit, lambda self, r, **k: (seen.extend(r), fit(self, r, **k))[1]
    try:
        model = toxicity_zstd.fit_toxicity(docs, labels)
    finally:
        toxicity_zstd.CompressionClassifier.fit = fit
    assert len(seen) == 80 and sum(y for _, y in seen) == 40
    scored = toxicity_zstd.toxicity_scores(docs, model)
    assert scored.count() == docs.count() and scored.where("not score between 0 and 1").count() == 0
    kept = toxicity_zstd.drop_toxic(docs, model, threshold=0.5)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 51 and kept.where("doc_id is null").count() == 1
    long = spark.createDataFrame([(1, "plain words " * 300_000)], "doc_id long, text string")
    assert toxicity_zstd.toxicity_scores(long, model).first()["score"] < 0.5


def test_kneser_ney_sums_to_one():
    rows = [("banana bandana", "x"), ("anagram nab", "x"), ("zorro zoo", "y"), ("", "y"), (None, "y")]
    model = langid_kn.KneserNeyLanguages(order=3).fit(rows)
    letters = sorted({c for t, _ in rows for c in langid_kn.characters(t).tolist()})
    for context in ("an", "zo", "qq"):
        total = np.zeros(2)
        for c in [*letters, 0x4E2D]:  # any character never seen stands for all of them
            codes = np.array([32, 32, *map(ord, context), c], np.uint32)
            total += np.exp(model._logs_at(langid_kn.gram_hashes(codes, 3), np.array([len(codes) - 1]))[0])
        assert np.allclose(total, 1), context


def test_languages(spark):
    texts = [("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de")] * 30
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)] + [(90, None, "en"), (91, "12 ++", "de"), (92, "the dog " * 200_000, None), (93, "", None)], "doc_id long, text string, lang string")
    model = langid_kn.fit_languages(docs, where=F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in langid_kn.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == x for i, (_, x) in enumerate(texts)) and got[92]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 93))
    assert langid_kn.identify(empty(spark), langid_kn.fit_languages(empty(spark))).count() == 0
    assert langid_kn.KneserNeyLanguages().fit([]).predict(["abc"])[0][0] == "und"


def test_languages_of_repeated_rows_and_blank_languages(spark):
    rows = [(1, "same text here", "en")] * 4 + [(2, "other words there", "en"), (3, "123", "xx"), (None, "no id at all", "en"), (4, "wort und satz", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"i": F.lit("clash"), "l": F.lit(0), "score": F.lit(1)})
    seen = []
    fit, langid_kn.KneserNeyLanguages.fit = langid_kn.KneserNeyLanguages.fit, lambda self, r: (seen.extend(r), fit(self, r))[1]
    try:
        model = langid_kn.fit_languages(docs)
    finally:
        langid_kn.KneserNeyLanguages.fit = fit
    assert sorted(t for t, _ in seen) == sorted(["same text here", "other words there", "123", "no id at all", "wort und satz"]) and model.languages == ["de", "en"]
    assert langid_kn.identify(docs, model).count() == len(rows)
    assert langid_kn.KneserNeyLanguages().fit([("123", "en")]).predict(["abc"]) == [("und", 0.0, None, True)]


def plain_kneser_ney(texts, order, text, seen):
    """Negative log-likelihood of a text by dictionaries of counts, straight from the definition."""
    pad = " " * (order - 1)
    norm = lambda t: re.sub(r"[^a-z]+", " ", t.lower()).lstrip()
    count = [{} for _ in range(order + 1)]
    for t in texts:
        whole = pad + norm(t)
        for i in range(len(pad), len(whole)):
            for n in range(1, order + 1):
                g = whole[i - n + 1 : i + 1]
                count[n][g] = count[n].get(g, 0) + 1
    for n in range(1, order):
        before = {}
        for g in count[n + 1]:
            before.setdefault(g[1:], set()).add(g[0])
        count[n] = {g: len(before.get(g, "x")) for g in count[n]}
    unseen = 1 / (seen + 1)  # characters of any language, and one more

    def p(context, c, n):
        if n == 0:
            return unseen
        ones, twos = sum(v == 1 for v in count[n].values()), sum(v == 2 for v in count[n].values())
        d = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.05), 0.95)
        own = {g: v for g, v in count[n].items() if g[:-1] == context}
        lower = p(context[1:], c, n - 1)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(context + c, 0) - d, 0) / total + d * len(own) / total * lower

    whole = pad + norm(text)
    return -sum(math.log(p(whole[i - order + 1 : i], whole[i], order)) for i in range(len(pad), len(whole)))


def test_kneser_ney_against_plain_counts():
    rng = random.Random(43)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 5)))
    learn = {x: [" ".join(word(a) for _ in range(6)) for _ in range(8)] for x, a in (("x", "abcde"), ("y", "cdefgh"))}
    model = langid_kn.KneserNeyLanguages(order=3).fit([(t, x) for x, ts in learn.items() for t in ts])
    seen = len({c for ts in learn.values() for t in ts for c in t})
    for _ in range(20):
        text = " ".join(word("abcdefghij") for _ in range(5))
        sums, _ = model._sums([langid_kn.characters(text)])
        assert sums[0].tolist() == pytest.approx([plain_kneser_ney(learn[x], 3, text, seen) for x in ("x", "y")])


# ------------------------------------------------------------------ pages


def test_extraction():
    page = """<html><body><header>Site</header><div class="sidebar">side</div><div id=content><h1>T &amp; x</h1><p>One<br>two   three<p>Four <b>bold</b>ly
    <div class="cookie-notice">cookies</div><ul><li>a<li>b</ul><form><p>f</form><table><tr><td>1<td>2</table><div class="comments"><p>nice</div></div><script>if (a < b) "</p>"</script><footer>f</footer>"""
    assert html_template.extract(page, None) == "T & x\nOne two three\nFour boldly\na\nb\n1\n2"
    assert html_template.extract("<p>a<!-- x > --> b</p><style>p{}</style>tail &lt;x&gt;", None) == "a b\ntail <x>"
    for odd in (None, "", "   ", "<", "<div", "<script>never closed", '<a href="unclosed>x'):
        html_template.extract(odd, None)
    assert html_template.extract("plain", None) == "plain"
    assert html_template.extract('<article class="post"><div class="article-header"><h1>T</h1></div><p class="text">x</p></article><article class="comment">no</article><div class="page-header">no</div>', None) == "T\nx"


def test_templates_of_hosts(spark):
    shell = "<html><body><nav><a href=x>Home</a></nav><div class=wrap><div class=crumb>You are here</div><div class=post><h2>{0}</h2><p>{1}</p><div class=k7><b>Read our standing note.</b></div></div></div><footer>(c)</footer></body></html>"
    rows = [(i, "http://a.example/" + str(i), shell.format(f"Title {i}", f"Body text number {i} " * 5)) for i in range(12)] + [(50, None, None), (51, "http://b.example/", "<p>lone</p>"), (52, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    t = {r["host"]: r for r in html_template.host_templates(pages).collect()}["a.example"]
    assert t["article"].endswith("div.post") and t["dropped"] == ["/html/body/div.wrap/div.post/div.k7"]
    assert ("/html/body/div.wrap/div.post/div.k7/b", "Read our standing note.") in [(c["path"], c["string"]) for c in t["constant"]]
    got = {r["page_id"]: r["text"] for r in html_template.extract_pages(pages.withColumn("host", F.lit("clash"))).collect()}
    whole = {r["page_id"]: r["text"] for r in html_template.extract_pages(pages, template=False).collect()}
    assert whole[3] == "You are here\n" + got[3] + "\nRead our standing note."  # so the template decides
    assert got[3] == "Title 3\n" + ("Body text number 3 " * 5).strip() and (got[50], got[51], got[52]) == ("", "lone", "")
    assert html_template.extract_pages(spark.createDataFrame([], pages.schema)).count() == 0
    twice = html_template.extract_pages(pages.unionAll(pages))
    assert twice.count() == 30 and {r["page_id"]: r["text"] for r in twice.collect()} == got
    long = pages.limit(6).withColumn("html", F.expr("concat('<article><p>', repeat('long words ', 400000), '</p></article>')"))
    assert {r["n_chars"] for r in html_template.extract_pages(long).collect()} == {4_399_999}


def test_template_without_telling_names(spark):
    """Menus, notices, promotions and page frames of meaningless names; sections that only sound like boilerplate stay."""
    rng, rows = random.Random(31), []
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    for i in range(40):
        menu = "".join(f"<a href=/{k}>{words(2)}</a>" for k in range(5))
        body = "".join(f"<p>{words(30)}</p>" for _ in range(rng.randint(2, 6)))
        notice = "<div class=q8><p>We keep small files on your machine.</p><p>Agree to this.</p></div>" if i % 10 else ""
        odd = '<section id="related-work"><p>earlier work</p></section><div class="social-history"><p>a history</p></div><p>as <math><mi>x</mi></math> and <object>y</object> say</p>' if i == 7 else ""
        rows.append((i, "http://h.example/x", f"<body><div class=a1><div class=b2>{menu}</div><span>{words(3)}</span></div><div class=c3><h1>{words(4)}</h1><ul class=d4>{menu}</ul>{body}{notice}{odd}</div><div class=e5>{words(3)}</div></body>"))
    got = {r["page_id"]: r["text"] for r in html_template.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        own = re.sub(r"<ul.*?</ul>|<div class=q8>.*?</div>", "", page[page.index("<h1>") : page.index("<div class=e5>")])
        want = [re.sub(r"\s+", " ", re.sub("<[^>]+>", "", x)).strip() for x in re.split(r"</?(?:h1|p|div|section)[^>]*>", own)]
        assert got[i] == "\n".join(filter(None, want)), i
    assert "earlier work\na history\nas x and y say" in got[7]


def test_hosts_of_copies_keep_their_article(spark):
    page = "<body><nav>n</nav><article><h1>One</h1><p>Same text on all pages of this host.</p></article></body>"
    rows = [(i, "http://c.example/", page) for i in range(30)] + [(99, "http://c.example/", page.replace("Same", "Other"))]
    got = {r["page_id"]: r["text"] for r in html_template.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "One\nSame text on all pages of this host." and got[99] == "One\nOther text on all pages of this host."


def test_classes_against_whole_vectors(spark):
    """Classes of the summed prints are those of the occurrence vectors themselves, page by page."""
    from xml.etree import ElementTree

    rng, rows = random.Random(32), []
    for i in range(25):
        part = lambda tag, share: f"<{tag}>{rng.choice(['same', 'other', f'n{i}'])}</{tag}>" if rng.random() < share else ""
        rows.append((i, "http://v.example/", f"<html><body><div>{part('b', 0.8) * 2}{part('i', 0.9)}</div><section>{part('h2', 0.7)}<div>fixed</div></section>{part('em', 0.95)}</body></html>"))
    vectors = {}
    for i, _, page in rows:
        stack = [("", ElementTree.fromstring(page))]
        while stack:
            above, node = stack.pop()
            path = f"{above}/{node.tag}"
            for token in [(path, ""), *([(path, node.text)] if node.text else [])]:
                vectors.setdefault(token, [0] * 25)[i] += 1
            stack += [(path, child) for child in node]
    groups = {}
    for token, v in vectors.items():
        if sum(x > 0 for x in v) >= 15:
            each = max(v) if set(v) <= {0, max(v)} else 1
            groups.setdefault(tuple(x // each for x in v), []).append(token)
    valid = {frozenset(g) for g in groups.values() if len(g) >= 2}
    while True:
        paths = {p for g in valid for p, s in g if not s}
        left = {g for g in valid if all((p if s else p.rpartition("/")[0]) in paths | {""} for p, s in g)}
        if left == valid:
            break
        valid = left
    got = html_template.host_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert {frozenset(tuple((t + "\t").split("\t")[:2]) for t in c) for c in got["classes"]} == valid


# ------------------------------------------------------------------ conversations


def test_escapes_are_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|><|end|>", "\\", "\\\\<|", "<\\|end|>", "<<SYS>> <s></s>", "a\n<|end|>b", "", "[INST][/INST]\\[INST]", "中文 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_tree.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_tree.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in (chat_tree.TURN, chat_tree.END, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_reply_trees(spark):
    #      1        2 is the better branch at depth 2, 5 the deepest leaf; tree 8 is a single node, null text
    rows = [(7, 1, None, "user", "q", 0.0), (7, 2, 1, "assistant", "a<|end|>", 5.0), (7, 3, 1, "assistant", "b", 1.0), (7, 4, 3, "user", "c", 1.0), (7, 5, 4, "assistant", "d", 1.0), (8, 1, 99, None, None, None)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    paths = {(r["tree"], r["leaf"], r["node"]): r["up"] for r in chat_tree.leaf_paths(nodes).collect()}
    assert paths == {(7, 2, 2): 0, (7, 2, 1): 1, (7, 5, 5): 0, (7, 5, 4): 1, (7, 5, 3): 2, (7, 5, 1): 3, (8, 1, 1): 0}
    best = {r["tree"]: r for r in chat_tree.read_back(chat_tree.conversations(nodes)).collect()}
    assert [(t["role"], t["text"]) for t in best[7]["turns"]] == [("user", "q"), ("assistant", "a<|end|>")] and best[7]["loss"] == "a<|end|>"
    assert [(t["role"], t["text"]) for t in best[8]["turns"]] == [("", "")]
    everything = chat_tree.read_back(chat_tree.conversations(nodes, None))
    assert {(r["tree"], r["leaf"]): r["loss"] for r in everything.collect()} == {(7, 2): "a<|end|>", (7, 5): "bd", (8, 1): ""}
    assert chat_tree.conversations(spark.createDataFrame([], nodes.schema)).count() == 0
    with pytest.raises(ValueError):
        chat_tree.leaf_paths(spark.createDataFrame([(1, 1, 2, "u", "", 0.0), (1, 2, 1, "u", "", 0.0), (1, 3, 1, "u", "", 0.0)], nodes.schema)).count()


def test_nodes_without_ids_and_twins(spark):
    rows = [(None, 1, None, "user", "q", None), (None, 2, 1, "assistant", "a", None), (3, None, None, "user", "lost", 1.0), (3, 1, None, "user", "b", 1.0), (3, 1, None, "user", "a", 1.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumns({"leaf": F.lit(1), "up": F.lit(2), "rank": F.lit(3)})
    got = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat_tree.read_back(chat_tree.conversations(nodes)).collect()}
    assert got == {None: ["q", "a"], 3: ["a"]}


def test_exact_without_ids(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (None, "b"), (7, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == sorted([(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (7, 7, 1, True)], key=str)


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(150)] + [(2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, "system", None)]
    got = {r["tree"]: r for r in chat_tree.read_back(chat_tree.conversations(chat_tree.parents_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [f"t{i}" for i in range(150)] and got[1]["loss"] == "".join(f"t{i}" for i in range(1, 150, 2))
    assert [t["role"] for t in got[2]["turns"]] == ["system", "user", "user"]


# ------------------------------------------------------------------ licenses


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "a/y.py", None),
        (5, "z.py", "Licensed under CC BY-NC 4.0.\nfoo"), (6, "q/z.py", ""), (7, None, "x"), (8, "a/b/z.py", "code\n" * 5000 + "This work is licensed under the GNU General Public License, version 3."), (9, "ab/y.py", "x"),
    ]
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", None), 2: ("Apache-2.0", "a/b/COPYING"), 3: ("Apache-2.0", None), 4: ("MIT", "a/LICENSE"), 5: ("CC-BY-NC-4.0", None), 6: (None, None), 7: (None, None), 8: ("GPL-3.0", None), 9: (None, None),
    }
    assert licenses.scan_licenses(empty(spark)).count() == 0


def plain_license(index, text):
    """The best stretch by comparing each with each template."""
    words, best = licenses.terms(text), None
    for t, (_, template) in enumerate(licenses.TEMPLATES):
        size = len(licenses.terms(template))
        tvec = {}
        for w in licenses.terms(template):
            tvec[w] = tvec.get(w, 0) + index.idf[index.code[w]]
        for s in range(len(words)):
            part = words[s : s + size]
            while part and part[-1] not in index.code:
                part = part[:-1]
            if not part or part[0] not in index.code:
                continue
            vec = {}
            for w in part:
                vec[w] = vec.get(w, 0) + (index.idf[index.code[w]] if w in index.code else index.rare)
            cosine = sum(v * tvec.get(w, 0) for w, v in vec.items()) / math.sqrt(sum(v * v for v in vec.values())) / math.sqrt(sum(v * v for v in tvec.values()))
            if cosine >= index.least - 1e-12 and (best is None or (-round(cosine, 12), s, t) < best):
                best = -round(cosine, 12), s, t
    return (None, 0.0) if best is None else (licenses.TEMPLATES[best[2]][0], -best[0])


def test_license_matches_are_the_plain_ones():
    rng, df = random.Random(41), {"the": 90, "license": 30, "of": 80, "and": 95, "to": 70, "is": 60}
    index = licenses.LicenseIndex(df, 100)
    words = [w for _, t in licenses.TEMPLATES for w in licenses.terms(t)]
    for k in range(120):
        body = [rng.choice(["prose", "x1", "words", "here", *words]) for _ in range(rng.randint(0, 60))]
        if k % 2:
            own = licenses.terms(rng.choice(licenses.TEMPLATES)[1])
            own = [w for w in own if rng.random() < 0.9]
            at = rng.randint(0, len(body))
            body[at:at] = own
        text = "".join(w + rng.choice([" ", "\n", " * "]) for w in body)
        name, similarity, line = index.match(text)
        assert (name, similarity) == pytest.approx(plain_license(index, text)) or (name, round(similarity, 9)) == (plain_license(index, text)[0], round(plain_license(index, text)[1], 9))
        assert (line is None) == (name is None)
    wrapped = "/*\n * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software and associated\n * documentation files (the \"Software\"), to deal in the\n * Software without restriction\n */\nint x;"
    assert index.match(wrapped)[0] == "MIT" and index.match(wrapped)[2] == 1
    assert index.match("Some prose before. Released under the MIT License. And more of it after that, at length.")[0] == "MIT"


def test_license_rows_that_repeat(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License.")] * 2 + [(1, "a/x", None)] * 3 + [(None, "b/y", "")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"own": F.lit("clash"), "id": F.lit(1), "similarity": F.lit("c")})
    got = sorted((str(r["doc_id"]), r["path"], str(r["license"])) for r in licenses.scan_licenses(df).collect())
    assert got == sorted([("1", "a/LICENSE", "MIT")] * 2 + [("1", "a/x", "MIT")] * 3 + [("None", "b/y", "None")])
    long = spark.createDataFrame([(1, "x", "word " * 300_000 + "\nLicensed under CC BY-NC 4.0.")], "doc_id long, path string, text string")
    assert licenses.scan_licenses(long).first()["own_license"] == "CC-BY-NC-4.0"


# ------------------------------------------------------------------ near copies: other edits, hot groups, exact similarity


def plain_similarity(a, b):
    grams = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def components_of(spark, texts, **params):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash_bk.similar_groups(rows, **params).collect()}
    return [got[i] for i in range(len(texts))]


def test_near_copies_of_any_edit(spark):
    rng, texts = random.Random(21), []
    fresh = lambda n, tag: [f"{tag}x{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(60):
        base = fresh(100, f"a{k}")
        texts += [" ".join(base), " ".join(base + fresh(24, f"b{k}"))]  # appended
    for k in range(60):
        base = fresh(250, f"c{k}")
        texts += [" ".join(base), " ".join(base[:202])]  # cut off
    for k in range(6):
        base = [f"d{k}x{rng.randrange(500)}" for _ in range(5000)]
        copy = [f"new{rng.randrange(10**9)}" if rng.random() < 0.02 else w for w in base]
        texts += [" ".join(base), " ".join(copy)]
    near = [i for i in range(0, len(texts), 2) if plain_similarity(texts[i], texts[i + 1]) >= 0.8]
    assert len(near) >= 120
    got = components_of(spark, texts)
    assert sum(got[i + 1] != i for i in near) <= 1


def test_hot_group_of_near_copies(spark):
    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for k in range(2300):
        copy = list(base)
        for at in rng.sample(range(400), rng.randint(1, 3)):
            copy[at] = f"e{k}x{at}"
        texts.append(" ".join(copy))
    assert set(components_of(spark, texts, shard_nodes=256)) == {0}


@pytest.mark.parametrize("shard_nodes", [1024, 5])
def test_links_are_exact(spark, shard_nodes):
    rng, texts = random.Random(23), []
    for family in range(6):
        base = [f"f{family}x{i}" for i in range(150)]
        for _ in range(15):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(0, 9)):
                copy[at] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    texts += [("the same line again and again " * 60) + " ".join(f"{k}y{i}" for i in range(40)) for k in range(4)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "q b c d e f g h i"]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if plain_similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want, got = [find(i) for i in range(len(texts))], components_of(spark, texts, shard_nodes=shard_nodes)
    assert all(want[i] == want[g] for i, g in enumerate(got))  # nothing linked below 0.8
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 1


def test_article_slot_holds_all_of_main(spark):
    page = "<html><body><nav>Home</nav><main><h1>Head {0}</h1><article class=lead><p>Lead words {0} {1}</p></article><article class=more><p>More {0} {2}</p></article></main><footer>(c)</footer></body></html>"
    apart = page.replace("<main>", "<div class=wrap>").replace("</main>", "</div>")
    rows = [(i, f"http://{h}.example/{i}", t.format(i, "lead " * 12, "more " * 8)) for h, t in (("a", page), ("b", apart)) for i in range(12)]
    for r in html_template.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r["page_id"]
        assert r["text"] == f"Head {i}\nLead words {i} " + " ".join(["lead"] * 12) + f"\nMore {i} " + " ".join(["more"] * 8)
