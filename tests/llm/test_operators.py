"""Operators against brute force, exact round trips and held-out labels."""

import hashlib
import math
import os
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, difference  # noqa: E402

import corpus_pipeline  # noqa: E402
from abstain_eval.llm import (  # noqa: E402
    cross_polytope, edit_embedding, kneser_ney, language, mixing, packing, page_difference, quality, queries, simhash, toxicity,
)

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


# Fingerprints


def test_fingerprints_against_texts(spark):
    docs = documents(SMALL)
    found = {r["doc_id"]: r for r in queries.op1_edit_embedding(spark, SMALL).collect()}
    assert len(found) == len(docs)
    by_text = defaultdict(set)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [found[i]["fingerprint"], found[i]["edited_fingerprint"]] == edit_embedding.fingerprints([text, edited])
        assert 0 <= found[i]["near_next"] <= 1 and 0.6 < found[i]["near_edited"] <= 1
        by_text[text].add(found[i]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert np.median([r["near_next"] for r in found.values()]) < 0.2


def walk(text, step_limit=edit_embedding.STEPS):
    """Digits written at every step of one segment, one character at a time."""
    codes = edit_embedding.classes_of(text)
    at, out = 0, []
    for step in range(step_limit):
        if at == len(codes):
            out.append(0)
            continue
        out.append(int(edit_embedding.DIGITS[codes[at]]))
        at += int(edit_embedding.MOVES[step][codes[at]])
    return out


def test_walks_one_by_one():
    texts = [documents(SMALL)[3][1][:900], "x", "a b", documents(SMALL)[5][1][:2048]]
    for text, found in zip(texts, edit_embedding.fingerprints(texts), strict=True):
        steps = walk(text)
        want = "".join(f"{steps[s]:x}" for s in sorted(edit_embedding.sampled(1)))
        assert found == want.rstrip("0")


def test_near_pairs_find_edited_copies(spark):
    base = [t for _, t in documents(SMALL) if len(t) > 800][:20]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:-40] + "some other ending of this text") for i, t in enumerate(base)]
    rows += [(200, base[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = edit_embedding.near_pairs(frame).collect()
    class_of = {r["doc_id"]: r["fingerprint"] for r in edit_embedding.class_members(frame).collect()}
    pairs = {frozenset((r["fingerprint_a"], r["fingerprint_b"])) for r in found}
    for i in range(20):  # in one class, or linked
        a, b = class_of[i], class_of[100 + i]
        assert a == b or frozenset((a, b)) in pairs
    assert class_of[200] == class_of[0] and len(pairs) > 5
    assert all(r["likeness"] >= edit_embedding.SAME for r in found)


def test_insertions_at_the_start_of_long_texts():
    def likeness(size, k, runs=8):
        rng = np.random.default_rng(6)
        letters = ["".join(map(chr, rng.integers(97, 123, size + k))) for _ in range(runs)]
        return float(np.mean(edit_embedding.likeness(edit_embedding.fingerprints(letters), edit_embedding.fingerprints([t[k:] for t in letters]))))

    # Mean of runs; walks that restarted every 2,048 characters had 0.25, 0.54, 0.28 and 0.15.
    assert likeness(20_480, 40) > 0.8
    assert likeness(200_000, 20) > 0.9
    assert likeness(200_000, 40) > 0.8
    assert likeness(200_000, 200) > 0.4


# Nearest neighbours


def exact_neighbours(rows):
    rows = [(i, np.array(v, float)) for i, v in rows]
    for i, v in rows:
        if i % cross_polytope.QUERY_STEP == 0:
            near = [(-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in rows if j != i]
            yield i, [j for _, j in sorted(near)[:5]]


def test_recall_of_neighbours(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{MIDDLE}/embeddings.parquet'").fetchall()
    found = defaultdict(list)
    for r in queries.op2_cross_polytope(spark, MIDDLE).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    exact = dict(exact_neighbours(rows))
    assert set(found) == set(exact)
    assert np.mean([len(set(found[q]) & set(w)) / len(w) for q, w in exact.items()]) >= 0.9


def test_awkward_vectors(spark):
    rows = [(i, [1.0, 0.0, float(i % 3 == 0)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 0.0]),
             (105, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (106, [1.0, 2.0]), (0, [1.0, 0.0, 1.0]), (150, [2.0, 0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("id", F.lit(2))
    found = defaultdict(list)
    for r in cross_polytope.nearest_neighbours(frame).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], round(r["score"], 12)))
    assert found[0] == [(i, 1.0) for i in (3, 6, 9, 12, 15)]
    assert found[50] == [(i, 1.0) for i in (1, 2, 4, 5, 7)]
    assert found[150] == [(i, 1.0) for i in (0, 3, 6, 9, 12)]
    assert set(found) == {0, 50, 150}
    assert cross_polytope.nearest_neighbours(frame.limit(0)).collect() == []


def test_transform_is_orthogonal():
    rows = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(rows)), 16 * rows)


# Packing


def test_pieces_are_the_tokenizers_ids(spark):
    found = defaultdict(dict)
    sequences = defaultdict(list)
    for r in queries.op3_best_fit_packing(spark, SMALL).collect():
        found[r["doc_id"]][r["piece"]] = r
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    encode = packing.WordTokenizer(packing.tokenizer_path()).whole.encode
    total = 0
    for i, text in documents(SMALL):
        ids = np.array([*encode(text, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            r = found[i].pop(n)
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(part), zlib.crc32(part.tobytes()))
        assert not found[i]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 1


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ naïve don't I'LL 12,5", "a\x1cb 　c\xa0d\r\ne", "<|endoftext|> été ﬁ ŉ ſ", "日本語 テスト", "ß ẞ ÿ Ÿ", "", "\n \n"])
def test_word_tokenizer_agrees(text):
    tokenizer = packing.word_tokenizer(packing.tokenizer_path())
    assert next(tokenizer([text])).tolist() == tokenizer.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["hello <|endoftext|> world x<|startoftext|>y", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> it's<|endoftext|>é", "<|endof text|>"])
def test_markers_are_ids_of_their_own(text):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer = packing.WordTokenizer(packing.tokenizer_path())
    for _ in range(2):  # also once words are kept
        assert next(tokenizer([text])).tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert fresh.encode("x<|startoftext|>y<|endoftext|>", add_special_tokens=False).ids == [343, 49406, 344, 49407]


def test_plans_use_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = Counter(rng.integers(1, 101, rng.integers(1, 300)).tolist())
        patterns = packing.plan_patterns(counts, 100)
        used = Counter()
        for lengths, times in patterns:
            assert sum(k * n for k, n in lengths.items()) <= 100
            for k, n in lengths.items():
                used[k] += n * times
        assert used == counts
    assert packing.plan_patterns({60: 4, 25: 4, 10: 4, 5: 4}, 100) == [({60: 1, 5: 1, 10: 1, 25: 1}, 4)]


# Language model


def brute_model(texts):
    """Counts of an interpolated modified Kneser-Ney model of word pairs, in dictionaries."""
    words, pairs = Counter(), Counter()
    for t in texts:
        tokens = [*t, "</s>"]
        words.update(tokens)
        pairs.update(zip(["<s>", *tokens[:-1]], tokens, strict=True))
    follows = Counter(w for _, w in pairs)
    begun = defaultdict(list)
    for (v, _), n in pairs.items():
        begun[v].append(n)

    def cuts(counts):
        n = Counter(min(c, 5) for c in counts.values())
        return kneser_ney.discounts({f"n{i}": n[i] for i in range(1, 5)})

    of_pairs, of_words = cuts(pairs), cuts(follows)
    types, all_follows = len(words), sum(follows.values())
    given = sum(of_words[min(c, 3) - 1] for c in follows.values()) / all_follows / (types + 1)

    def chance(v, w):
        lower = (max(follows[w] - of_words[min(follows[w], 3) - 1], 0) if follows[w] else 0) / all_follows + given
        if v not in begun:
            return lower
        total = sum(begun[v])
        n = pairs[v, w]
        kept = max(n - of_pairs[min(n, 3) - 1], 0) if n else 0
        return kept / total + sum(of_pairs[min(c, 3) - 1] for c in begun[v]) / total * lower

    return words, chance


def test_scores_against_dictionaries(spark):
    docs = [(i, [w.decode() for w in t.encode().lower().split()]) for i, t in documents(SMALL)]
    training = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    words, chance = brute_model(training)
    total, types = sum(words.values()), len(words)
    found = {r["doc_id"]: r for r in queries.op4_kneser_ney(spark, SMALL).collect()}
    for i, tokens in docs:
        r, all_tokens = found[i], [*tokens, "</s>"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(all_tokens), total)
        assert r["n_known"] == sum(words[w] > 0 for w in all_tokens)
        assert math.isclose(r["base_score"], sum(math.log10((words[w] + 1) / (total + types + 1)) for w in all_tokens), rel_tol=1e-9)
        want = sum(math.log10(chance(v, w)) for v, w in zip(["<s>", *tokens], all_tokens, strict=True))
        assert math.isclose(r["score"], want, rel_tol=1e-9)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    for v in ["<s>", training[0][0], "never seen"]:
        assert math.isclose(sum(chance(v, w) for w in words) + chance(v, "unknown"), 1, rel_tol=1e-9)


# SimHash


def brute_simhash(text):
    import xxhash

    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    docs = documents(SMALL)
    prints = [brute_simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {d: (f"{p:016x}", docs[find(i)][0]) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, SMALL).collect()}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 200), (203, 205), (7, 7 + 1)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(frame).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 203, 205), 200)}


def test_close_pairs_at_every_distance(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    values = set(map(int, base))
    for b in base:
        for n in (1, 2, 3, 4):
            flip = 0
            for bit in rng.choice(64, n, replace=False):
                flip |= 1 << int(bit)
            values.add((int(b) & (2**64 - 1) ^ flip) - (2**64 if (int(b) & (2**64 - 1) ^ flip) >> 63 else 0))
    values = sorted(values)
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {(r["a"], r["b"]) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "f long")).collect()}
    assert got == want


# Classifiers


def held_out(found, truth):
    rows = [(r, truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 50
    return rows


def test_quality_on_held_out_labels(spark):
    truth = dict(duckdb.sql(f"select doc_id, quality from '{MIDDLE}/labels.parquet'").fetchall())
    rows = held_out(queries.op6_quality(spark, MIDDLE).collect(), truth)
    assert np.mean([r["predicted"] == y for r, y in rows]) > 0.97


def test_quality_hears_words():
    rng = np.random.default_rng(8)
    good, junk = (["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(200)] for _ in range(2))
    texts = [" ".join(rng.choice(words, 80)) for words in (good, junk) for _ in range(60)]
    labels = np.repeat([1, 0], 60)
    learned = np.arange(120) % 3 > 0
    found = np.vstack([quality.counts([t]) for t in texts])
    model = quality.NearestVotes(found[learned], labels[learned], {0: 0.5, 1: 0.5})
    score = model([t for t, k in zip(texts, learned, strict=True) if not k])
    assert np.mean((score > 0.5) == labels[~learned]) > 0.95


def test_toxicity_on_held_out_labels(spark):
    # Junk documents (quality 0) are marked toxic here without a toxic word in them.
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{MIDDLE}/labels.parquet' where quality = 1").fetchall())
    rows = held_out(queries.op7_toxicity(spark, MIDDLE).collect(), truth)
    assert np.mean([r["predicted"] == y for r, y in rows]) > 0.95


@pytest.mark.parametrize(("totals", "least"), [((1_000_000, 1_000_000), 7), ((110_000, 890_000), 3)])
def test_rare_toxic_expressions_speak_between_equal_classes(totals, least):
    toxic = np.array([least - 1, least, 30, 10, 0, 300, 150])
    ordinary = np.array([0, 0, 0, 10 * totals[1] // totals[0], 300, 0, 150 * totals[1] // totals[0]])
    gap = toxicity.ClassModels(np.arange(7, dtype=np.int64), toxic, ordinary, totals, 0.1).gap
    assert gap[0] == 0 and np.isfinite(gap).all()
    assert 0 < gap[1] < gap[2] < gap[5] and gap[4] < 0
    assert abs(gap[3]) < 1e-6 and abs(gap[6]) < 1e-6


def test_language_on_held_out_documents(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{MIDDLE}/documents.parquet'").fetchall())
    rows = held_out(queries.op10_language(spark, MIDDLE).collect(), truth)
    assert np.mean([r["lang_pred"] == y for r, y in rows]) > 0.96


def test_triple_vectors_one_by_one():
    def vector(text):
        text = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        while "  " in text:
            text = text.replace("  ", " ")
        points = [0 if c == " " else ord(c) for c in text]
        v = language.letter_vector
        return sum(np.roll(v(a), 2).astype(int) * np.roll(v(b), 1) * v(c) for a, b, c in zip(points, points[1:], points[2:], strict=False))

    texts = ["Straße, and 12 more", "été"]
    for found, text in zip(language.text_vectors(texts), texts, strict=True):
        assert found.tolist() == vector(text).tolist()


# Mixing


def test_mix_against_sql(spark):
    for sf_dir in (SMALL, MIDDLE):
        assert difference(spark, connect(sf_dir), queries.op8_source_mix, queries.ORACLES["op8_source_mix"], sf_dir) == ""


def test_mix_follows_targets_and_stays_native(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source")
    )
    targets = spark.createDataFrame([("hot", 1.0), ("s1", 3.0)], "source string, weight double")
    mixed = mixing.mix(docs, targets)
    shares = {r["source"]: r["n"] for r in mixed.groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    assert set(shares) == {"hot", "s1"} and abs(shares["hot"] - 5000) < 400 and abs(shares["s1"] - 15_000) < 900
    assert "Python" not in mixed._jdf.queryExecution().toString()


# Pages


def test_articles_of_given_pages(spark):
    import html
    import re

    pages = duckdb.sql(f"select page_id, html from '{MIDDLE}/pages.parquet'").fetchall()
    found = {r["page_id"]: r for r in queries.op9_page_difference(spark, MIDDLE).collect()}
    for i, page in pages:
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        parts = (" ".join(html.unescape(p).split()) for p in re.split(r"</?p>|</?h1>|<br>", article))
        want = "\n\n".join(p for p in parts if p)
        assert (found[i]["text"], found[i]["n_chars"]) == (want, len(want))


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_against_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(800):
        a, b = (rng.integers(0, 4, rng.integers(0, 9)) for _ in range(2))
        keep = page_difference.shared_lines(a, b)
        assert keep.sum() == longest_common(a.tolist(), b.tolist())
        rest = iter(b.tolist())
        assert all(x in rest for x in a[keep].tolist())


def test_long_alignments_are_split():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9000, 24_000), rng.integers(0, 9000, 24_000)
    keep = page_difference.shared_lines(a, b)
    row = page_difference._rows(a.tolist(), b.tolist(), False)[0]
    assert keep.sum() == page_difference._lengths(row, len(b))[-1]


def test_unmarked_pages_lose_shared_lines(spark):
    def page(*blocks):
        return "<body><div>Top of site</div>" + "".join(f"<div>{b}</div>" for b in blocks) + "<div>All rights</div></body>"

    rows = [(i, f"http://h.example/a/{i:03d}?q={i}", page(f"text {i}", "always here" if i % 2 else f"only {i}")) for i in range(300)]
    rows += [(1000, "http://alone.example/x", page("single page")), (1001, None, page("null address")), (1002, "http://h.example/z", None)]
    rows += [(1003, "http://e.example/1", ""), (1004, "http://copy.example/1", page("same")), (1005, "http://copy.example/2", page("same"))]
    rows += [(1004, "http://copy.example/1", page("same")), (None, "http://alone.example:80/x", page("other"))]
    rows += [(2000 + i, f"http://marked.example/{i}", page(f"<article>piece {i}</article>")) for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("code", F.lit(1))
    found = defaultdict(list)
    for r in page_difference.main_texts(frame.repartition(7)).collect():
        found[r["page_id"]].append(r["text"])
    for i in range(1, 299):
        # The nearest page is a neighbour, whose other line differs.
        assert found[i] == [f"text {i}\n\n" + ("always here" if i % 2 else f"only {i}")], i
    assert found[1001] == ["Top of site\n\nnull address\n\nAll rights"]
    assert found[1000] == ["single page"] and found[None] == ["other"]
    assert found[1002] == [""] and found[1003] == [""]
    assert found[2000] == ["piece 0"] and found[2001] == ["piece 1"]
    assert found[1004] == ["Top of site\n\nsame\n\nAll rights"] * 2 and found[1005] == found[1004][:1]
    assert page_difference.main_texts(frame.limit(0)).collect() == []


FRAMED = """<html><head><title>t</title><style>x</style></head><body><header>H</header><nav>N</nav>
<div class="cookie-notice">C</div><div role="banner">B</div><form>F</form><main><h1>Title</h1><p>One &amp; <b>two</b>
 three<br>four<ul><li>a<li>b</ul><aside>A</aside><script>if (a < b) "</p>"</script><pre>x
 y</pre></main><div id="comments">R</div><div hidden>Z</div><footer>&copy;</footer>"""


def test_frames_and_characters():
    assert [t for t, _ in page_difference.lines(FRAMED)] == ["Title", "One & two three four", "a", "b", "x y"]
    assert page_difference.lines("<p>broken <") == [("broken <", False)]
    assert page_difference.lines(None) == []


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div id='page' class='sticky header'", "div class='widget main-column'", "form id='all'", "span class='share'"])
@pytest.mark.parametrize("marked", ["article", "main"])
def test_names_of_wrappers_lose_no_article(wrapper, marked):
    page = f"<body><nav>N</nav><div class='sidebar'>S</div><{wrapper}><div class='menu'>M</div><{marked}><header class='entry-header'><h1>Title</h1></header><p>Text</p></{marked}></{wrapper.split()[0]}></body>"
    assert page_difference.lines(page) == [("Title", True), ("Text", True)]


def texts(page):
    return [t for t, _ in page_difference.lines(page)]


def test_whole_names_frame_inside_articles():
    page = "<article><p class='tags'>B <span class='shared'>C</span> <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><nav>N</nav></article><div class='tags'>T</div>"
    assert page_difference.lines(page) == [("B C x=1", True)]
    assert page_difference.lines("<main><div id='comments'>R</div><p>P</p></main>") == [("P", True)]
    assert texts("<article><p>Main.</p><div class='advert'>Buy now</div><div id='comments'>First!</div><p class='post-comment-rules'>Last.</p></article>") == ["Main.", "Last."]
    # Not if they hold the headline or most of the text.
    assert texts("<article><div class='related'><h1>Title</h1></div><p>Text that goes on.</p></article>") == ["Title", "Text that goes on."]
    assert texts("<article><h1>T</h1><div class='promo'>Nearly all of the text stands here.</div><p>End.</p></article>") == ["T", "Nearly all of the text stands here.", "End."]


def test_articles_of_readers_are_comments():
    page = "<article><h1>T</h1><p>Text.</p></article><section class='comments'><article class='comment'><p>Me too.</p></article></section><article class='reply'>So?</article>"
    assert texts(page) == ["T", "Text."]
    assert texts("<main><p>Text.</p><article class='comment'>No!</article></main>") == ["Text."]


def test_only_hidden_elements_are_hidden():
    assert texts("<article><p title='a hidden gem'>A</p><p class='md hidden lg'>B</p><p><span aria-hidden='true'>*</span>C</p><p data-x=hidden>D</p></article>") == ["A", "B", "*C", "D"]
    assert texts("<article><p hidden>A</p><p hidden=''>B</p><p style='color:red; display: none'>C</p><p HIDDEN class=x>D</p><p>E</p></article>") == ["E"]


@pytest.mark.parametrize("unit", ["<li class='menu-item menu'>a", "<div class='ad'>b</div>", "</b>", "<b>x", "<article class='comment'>c</article>"])
@pytest.mark.parametrize("end", ["", "<article><p>Text</p></article>"])
def test_long_pages_take_linear_time(unit, end):
    import time

    times = []
    for size in (250_000, 2_000_000):
        page = unit * (size // len(unit)) + end
        began = time.perf_counter()
        page_difference.lines(page)
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * 3 * max(times[0], 0.1)


# Pipeline


def test_pipeline_against_its_operators(spark):
    docs = duckdb.sql(f"select doc_id, source from '{MIDDLE}/documents.parquet'").fetchall()
    good = {r["doc_id"] for r in queries.op6_quality(spark, MIDDLE).collect() if r["predicted"]}
    truth = dict(duckdb.sql(f"select doc_id, quality from '{MIDDLE}/labels.parquet'").fetchall())
    assert np.mean([i in good for i, y in truth.items() if y == 1]) > 0.98
    frame = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    kept = frame.filter(F.col("doc_id").isin([int(i) for i in good]))
    components = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(language.in_known_language(kept)).collect()}
    stay = {i for i, c in components.items() if i == c}
    sizes = Counter(s for i, s in docs if i in stay)
    weight = {s: math.sqrt(n) for s, n in sizes.items()}
    copies = Counter()
    for i, s in docs:
        if i in stay:
            rate = weight[s] / sum(weight.values()) * len(stay) / sizes[s]
            u = int(hashlib.md5(f"{mixing.SEED}|copies|{i}".encode()).hexdigest()[:13], 16) / 2**52
            k, term, total = 0, math.exp(-rate), math.exp(-rate)
            while total <= u:
                k += 1
                term *= rate / k
                total += term
            copies[i] = k
    packed = corpus_pipeline.run(spark, MIDDLE).filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in packed} == {i: n for i, n in copies.items() if n}
    assert quality.ACCEPT == 0.3 and toxicity.ACCEPT == 0.5
