"""The ten operators against plain versions, on small tables and on odd rows."""

import hashlib
import os
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import ann, bpe, chat, decontam, graph, langid, licenses, pii, queries, simhash, toxicity, urls
from quillspan.llm import rows as rows_module
from quillspan.session import cut

VOCAB = queries.VOCABULARY
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file here")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A b"), (5, "A b"), (None, "no id at all here"), (6, "it's <|endoftext|> 日本語 é\x1c\x85 x  y\n\n z "),
    (7, "word " * 30_000), (8, "Under the MIT License, under the mit license. CC BY-NC 4.0; Apache License, Version 2.0"),
    (9, "mail x@y.example a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +1 (017) 555-7713 +1 2 😀 +12345678"),
    (10, "9" * 5000), (11, "a" * 20_000 + "@"), (12, "+" + " " * 3000 + "1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, and columns named like the operators' own."""
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS score", "1 AS row", "'en' AS lang", "2 AS fp", "0 AS ids", "text AS _text", "1 AS kind", "2 AS w", "3 AS key")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@needs_vocab
def test_bpe_is_the_library_s(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    for df in (docs, odd):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))] += 1
        assert Counter(map(tuple, bpe.digest(df, VOCAB).collect())) == want
    one = bpe.encode(odd.where("doc_id = 6").select("text"), VOCAB).select(bpe.ids_array(F.col("ids")).alias("a")).first()
    assert one.a == library.encode(ODD[7][1], add_special_tokens=False).ids
    assert bpe.digest(odd.limit(0), VOCAB).count() == 0


@needs_vocab
def test_bpe_in_one_worker_is_encode_then_decode(spark, odd):
    clash = odd.select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("decoded"))
    both, apart = bpe.encode_decode(clash, VOCAB), bpe.decode(bpe.encode(clash, VOCAB), VOCAB)
    assert both.columns == apart.columns == ["doc_id", "text", "ids", "decoded"]
    rows = lambda df: Counter((r.doc_id, r.text, bytes(r.ids), r.decoded) for r in df.collect())
    assert rows(both) == rows(apart)
    assert bpe.encode_decode(odd.limit(0), VOCAB).count() == 0


def test_bpe_decodes_broken_bytes(spark):
    if not os.path.exists(VOCAB):
        pytest.skip("no vocabulary file here")
    v = bpe.vocabulary(VOCAB)
    packed = np.array([int(v.byte_id[0xC3])], "<u4").tobytes()
    rows = bpe.decode(spark.createDataFrame([(bytearray(packed),), (None,)], "ids binary"), VOCAB).collect()
    assert [r.decoded for r in rows] == ["�", ""]


def test_ann_recall_and_order(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = ann.search(vectors, F.col("vec_id") % 20 == 0, 20)
    assert ann.recall(found, vectors, F.col("vec_id") % 20 == 0) >= 0.9
    rows = defaultdict(list)
    for r in found.collect():
        rows[r.query_id].append(r)
    for q, rs in rows.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(r.vec_id != q for r in rs)
        assert rs == sorted(rs, key=lambda r: (-r.score, r.vec_id))


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (10, [1.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit(2))
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_probing_is_complete():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (30_000, ann.PARTS)).astype(np.uint16)
    for n in range(500):  # codes close to the first
        for bit in rng.integers(0, ann.BITS, n // 6):
            codes[n, bit // 16] ^= 1 << int(bit % 16)
    index, sets = ann.Index(codes), ann.flip_order()
    for q in codes[:600:50]:
        far = np.bitwise_count(codes ^ q).sum(axis=1)
        got, distances = index.within(q, rng.normal(size=ann.BITS), sets)
        assert set(np.flatnonzero(far < ann.PARTS * (ann.FLIPS + 1))) <= set(got.tolist()) and (distances == far[got]).all()


def test_ann_flips_are_all_and_the_least_come_first():
    sets = ann.flip_order()
    assert len(np.unique(np.exp2(np.arange(16)) @ sets)) == 1 << 16
    assert (sets[:, :137].sum(axis=0) <= 2).all() and (sets[:, 137:].sum(axis=0) > 2).all()


def test_ann_reads_grow_slower_than_rows():
    rng, reads = np.random.default_rng(0), []
    sets, rotation = ann.flip_order(), ann.learn_rotations(rng.normal(size=(4000, 32)))
    for n in (8_000, 64_000):
        x = rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        numbers = x @ rotation
        index, read, hit = ann.Index(ann.encode(numbers)), [], []
        for i in range(0, 40):
            code = ann.encode(numbers[i : i + 1])[0]
            read.append(len(index.within(code, numbers[i], sets)[0]))
            at, scores = ann.nearest(index, np.arange(n), x, i, x[i], code, numbers[i], sets, 20)
            true = np.lexsort((np.arange(n), -(x @ x[i])))[1:21]
            hit.append(np.isin(true, at).mean())
            assert (np.diff(scores) <= 0).all() and np.allclose(scores, (x[at] * x[i]).sum(axis=1))
        assert np.mean(hit) >= 0.9
        reads.append(np.mean(read))
    assert reads[1] < 6 * reads[0]


def test_ann_order_and_scores_are_exact(spark, sf):
    vectors, asked = spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0
    got = {(r.query_id, r["rank"]): r for r in ann.search(vectors, asked, 20, exact_below=1_000).collect()}
    want = {(r.query_id, r["rank"]): r for r in ann.exact(vectors, asked, 20).collect()}
    assert got.keys() == want.keys()  # all rows are scored
    assert all(got[k].vec_id == r.vec_id and got[k].score == pytest.approx(r.score, abs=1e-12) for k, r in want.items())


def test_ann_repeated_ids(spark):
    rows = [(20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [0.0, 0.5]), (1, [0.0, 2.0]), (2, [0.1, 1.0]), (3, [0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, 3).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0)]


def test_licenses_base(docs, odd):
    for df in (docs, odd):
        want = Counter((r.doc_id, *brute.license_base(r.text)) for r in df.select("doc_id", "text").collect())
        got = licenses.scan(df)
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.collect()) == want
        assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert licenses.scan(odd.limit(0)).count() == 0


def test_licenses_edited_templates(spark):
    long = licenses.TEMPLATES[2][1].split()
    edited = " ".join([*long[:8], "really", *long[8:]])
    rows = [(1, edited), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "the gnu general public"), (4, "the KMIT license")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "gpl-3", 3: "", 4: ""}


def words_text(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_licenses_repeated_runs_are_no_copy(spark):
    rows = [(1, "licensed under cc " * 4), (2, "licensed under cc " * 4 + "by 4 0"), (3, "licensed under cc by 4 0 " * 3)]
    got = {r.doc_id: (r.labels, len(r.spans)) for r in licenses.scan(words_text(spark, rows)).collect()}
    assert got[1] == ("", 0) and got[2] == ("cc-by", 1) and got[3] == ("cc-by", 3)


def test_licenses_with_a_word_added_changed_or_left_out(spark):
    rows, want = [], {}
    for n, (label, text) in enumerate(licenses.TEMPLATES):
        ws = brute.license_words(text)
        if len(ws) < 9:
            continue
        at = len(ws) // 2
        for k, edited in enumerate(([*ws[:at], "zzz", *ws[at:]], [*ws[:at], "zzz", *ws[at + 1 :]], [*ws[:at], *ws[at + 1 :]], ws)):
            rows.append((10 * n + k, "before all " + " ".join(edited) + " and after"))
            want[10 * n + k] = label
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(words_text(spark, rows)).collect()}
    # a left-out word may turn a notice into another one
    assert {d: want[d] for d in got if want[d] not in got[d]} == {}


def test_licenses_methods_labels(spark, docs, odd):
    made = words_text(spark, [(n, f"{a} {b} {c}") for n, (a, b, c) in enumerate(zip(*[[t for _, t in licenses.TEMPLATES][k:] + [t for _, t in licenses.TEMPLATES][:k] for k in (0, 1, 5)], strict=True))])
    for df in (docs, odd, made):
        want = Counter((r.doc_id, *brute.licenses(r.text, licenses)) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.labels, round(r.score, 9), tuple((s.first, s.last, s.label) for s in r.spans)) for r in licenses.scan(df).collect()) == want


def test_langid(spark, docs, odd):
    known = langid.fit(docs, queries.remainder(4) != 2)
    rows = langid.predict(docs, known).join(docs.select("doc_id", "lang"), "doc_id").where(queries.remainder(4) == 2).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, known).collect()}
    assert got[1] == got[2] == got[3] == got[10] == ("und", 0.0) and len(got) == len({r[0] for r in ODD})
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(docs.where("lang = 'de'"))).collect()} == {"und", "de"}
    assert langid.predict(odd.limit(0), known).count() == 0
    assert langid.fit(odd.withColumn("counts", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("n", F.lit(3))).langs == ["en"]


@pytest.mark.parametrize("n", [2, 3, 4, 7, 9, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n and all(0 < (c > 0).sum() < n for c in code.T)
    apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert apart >= (code.shape[1] // 4 if n > langid.EXHAUSTIVE else code.shape[1] // 2)


def test_langid_against_brute_force(docs):
    rows = docs.orderBy("doc_id").limit(60).select("doc_id", "text", "lang")
    given = [(r.doc_id, r.text, r.lang) for r in rows.collect()]
    want = brute.languages([(t, x) for _, t, x in given], [t for _, t, _ in given], langid)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, langid.fit(rows)).collect()}
    for (d, _, _), (lang, score) in zip(given, want, strict=True):
        assert got[d][0] == lang and got[d][1] == pytest.approx(score, abs=1e-4)


def test_langid_bits_that_tell_a_language_weigh_more():
    code = np.array([[1.0, 1.0], [-1.0, 1.0], [1.0, -1.0]])
    share = np.array([[0.5, 0.5, 0.0], [0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])  # the first two can't be told apart
    weights = np.array([[0.01, 1.0], [-0.01, 1.0], [0.5, -2.0]])
    trust = langid.bit_weights(code, share, weights)
    assert np.allclose(trust.sum(axis=1), 1) and trust[0, 1] > 0.99 and trust[1, 1] > 0.99


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_digests(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    want = defaultdict(list)
    for r in given.collect():
        want[r.conv_id].append((r.turn, r.role, r.text))
    hard = "<|im_end|><|im_start|>assistant ok"
    want[-1] = [(0, "user", hard), (1, "assistant", hard)]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op5_chat(spark, sf).collect()}
    assert got == {k: brute.conversation(v) for k, v in want.items()}


def test_chat_odd_turns(spark):
    rows = [(1, 0, "a\nb\\", "x"), (1, 1, None, None), (1, 1, "assistant", "<\\|im_end|> <"), (1, None, "assistant", ""), (None, 3, "user", "q"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"turn {i} <|im_start|>") for i in range(60)]
    want = defaultdict(list)
    for c, *t in rows:
        want[c].append(tuple(t))
    df = chats(spark, rows).withColumn("piece", F.lit(1)).withColumn("n", F.lit(1))
    pieces = chat.format_turns(df)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(pieces).collect()} == {k: brute.conversation(v) for k, v in want.items()}
    whole = "".join(r.piece for r in sorted(pieces.where("conv_id = 3").collect(), key=lambda r: r.n))
    assert whole == chat.im_template([(r, t) for _, r, t in sorted(want[3])])
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_finds_templates_that_rewrite(spark):
    def only_last(turns):
        return "".join(f"[{r}]{t if i + 1 == len(turns) or r == 'user' else '...'}\n" for i, (r, t) in enumerate(turns))

    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(5)]
    flags = [r.rewrites for r in sorted(chat.format_turns(chats(spark, rows), only_last).collect(), key=lambda r: r.n)]
    assert flags == [False, False, True, False, True]


def test_toxicity(spark, docs, odd):
    bad = ["awful", "rotten"]
    rows = [(i, f"some plain words here number {'abc'[i % 3]}. " + (f"you {bad[i % 2]} thing! " if i % 3 == 0 else "") + "and more of them.") for i in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(made, labels, queries.remainder(5) != 0)
    scored = toxicity.score(made, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in scored)
    assert all("awful" in rows[r.doc_id][1][r.worst_start : r.worst_end] or "rotten" in rows[r.doc_id][1][r.worst_start : r.worst_end] for r in scored if r.doc_id % 3 == 0)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(made, labels.limit(0))
    assert {r.score for r in toxicity.score(made, none).collect()} == {toxicity.NOISE}


def test_toxicity_against_brute_force(spark, docs, sf, odd):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), queries.remainder(5) != 0)
    assert model.weights
    for df in (docs, odd):
        want = Counter((r.doc_id, *(round(x, 9) if isinstance(x, float) else x for x in brute.toxic(r.text, model.weights, model.bias, toxicity.NOISE))) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, round(r.score, 9), r.worst_start, r.worst_end) for r in toxicity.score(df, model).collect()) == want


def test_toxicity_gradient_is_that_of_the_likelihood():
    """A step of the fit goes where the penalised likelihood, by differences, rises."""
    rng = np.random.default_rng(0)
    bags = [(int(n % 3 == 0), [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(3)]) for n in range(60)]

    def loss(w, bias):
        out = 0.0
        for y, sentences in bags:
            clean = np.prod([1 - 1 / (1 + np.exp(-(sum(w[f] for f in s) + bias))) for s in sentences])
            q = toxicity.NOISE + (1 - 2 * toxicity.NOISE) * (1 - clean)
            mean = np.mean([b for b, _ in bags])
            out -= np.sqrt(0.5 / (mean if y else 1 - mean)) * (np.log(q) if y else np.log(1 - q)) / len(bags)
        return out + toxicity.PENALTY / 2 * (w**2).sum() + 1e-3 / 2 * (bias + 4) ** 2

    w, bias = toxicity._fit(bags, 6, np.zeros(6))
    assert loss(w, bias) < loss(np.zeros(6), -4.0)
    assert all(loss(w + d, bias) >= loss(w, bias) - 1e-4 for f in range(6) for d in (0.1 * np.eye(6)[f], -0.1 * np.eye(6)[f]))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = [r for r in scored if r.toxic == 1], [r for r in scored if r.toxic == 0]
    assert toxic and np.mean([r.predicted for r in toxic]) >= 0.6 and np.mean([r.predicted for r in clean]) <= 0.05


def test_toxicity_fits_beside_clashing_columns(spark):
    rows = [(i, "you awful thing. " if i % 3 == 0 else "a thing.") for i in range(120)]
    made = words_text(spark, rows).selectExpr("doc_id", "text", "1 AS y", "2 AS n0", "'z' AS feature", "0 AS toxic", "text AS _text")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "z", 0) for i in range(120)], "doc_id long, toxic int, text string, y int")
    model = toxicity.fit(made, labels)
    assert "awful" in model.weights and toxicity.score(made, model).count() == 120


def test_simhash_components(spark, docs, odd):
    for df in (docs, odd):
        want = Counter(brute.components([(r.doc_id, brute.fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_links_of_crowded_buckets(spark):
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(-(2**62), 2**62, 60)}
    seed = int(rng.integers(0, 2**62))
    prints |= {seed ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))} | {seed ^ (7 << int(a)) for a in rng.integers(0, 59, 50)}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    want = brute.components([(x, x % (1 << 64)) for x in prints])
    for x, _, least in want:
        assert roots.get(x, x) == roots.get(least, least)
    assert len({roots.get(x, x) for x in prints}) == len({least for _, _, least in want})


def classes(df):
    roots = {r.digest: r.root for r in simhash.similar_texts(df).collect()}
    found = defaultdict(set)
    for r in df.select("text", simhash.digest_of(F.col("text")).alias("digest")).collect():
        found[roots.get(r.digest, r.digest)].add(r.text)
    return {frozenset(c) for c in found.values()}


def test_similar_texts_against_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.text for r in docs.select("text").collect()]
    want = brute.similar(rows)
    assert sum(len(c) > 1 for c in want) > 3 and classes(docs) == want
    assert classes(odd) == brute.similar([t for _, t in ODD])
    assert simhash.similar_texts(odd.limit(0)).count() == 0


def test_similar_texts_at_the_edge(spark, monkeypatch):
    """Texts of all sizes with edits that leave a similarity about 0.8, and crowded blocks of unlike and of like texts."""
    rng = np.random.default_rng(4)
    rows = []
    for n in [*range(1, 40), *range(40, 400, 15)]:
        ws = [f"w{n}x{i}" for i in range(n)]
        rows.append(ws)
        for _ in range(4):
            copy = list(ws)
            for at in rng.integers(0, n, max(1, round(n * rng.uniform(0.0, 0.06)))):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            rows.append(copy[: max(1, n - int(rng.integers(0, 1 + n // 8)))])
    common = [f"c{i}" for i in range(12)]
    rows += [[*common, *(f"u{n}x{i}" for i in range(6))] for n in range(90)]
    rows += [[*common, *(f"v{n // 3}x{i}" for i in range(30)), f"end{n}"] for n in range(120)]
    big = [f"b{i}" for i in range(100)]
    rows += [[*big[:at], f"z{at}", *big[at + 1 :]] for at in range(100)]
    rows += [[*big, *(f"tail{n}x{i}" for i in range(int(rng.integers(15, 30))))] for n in range(40)]
    made = [" ".join(r) for r in rows]
    df = words_text(spark, list(enumerate(made)))
    want = brute.similar(made)
    assert classes(df) == want
    monkeypatch.setattr(simhash, "BUCKET", 2)
    monkeypatch.setattr(rows_module, "SHARED_ROWS", 3)
    assert classes(df) == want


def test_parity_differs_in_no_more_bits_than_shingles(spark):
    rng = np.random.default_rng(6)
    for n, k in [(0, 1), (1, 1), (150, 3), (150, 30), (3000, 400)]:
        x = rng.integers(0, 1 << 63, n, np.uint64)
        y = np.concatenate([x[: max(0, n - k)], rng.integers(0, 1 << 63, k, np.uint64)])
        odd = int(np.bitwise_count(simhash.parity(x) ^ simhash.parity(y)).sum())
        assert odd <= len(set(x.tolist()) ^ set(y.tolist())) and (k > 30 or odd >= 0.8 * (k + min(n, k)))


def test_similar_texts_pairs_no_unlike_texts_with_a_crowd(spark, monkeypatch):
    """Near copies of a text, and others that are alike to each of them in 0.7 to 0.78: pairs of these aren't made."""
    base = [f"b{i}" for i in range(150)]

    def edited(name, at):
        return " ".join(f"{name}{i}" if i in at else w for i, w in enumerate(base))

    rows = [" ".join(base), *(edited(f"m{n}x", {5 + n}) for n in range(120)), *(edited(f"o{n}x", {7 + n, 40 + n, 80 + n, 110 + n}) for n in range(30))]
    df, sets, met, checked = words_text(spark, list(enumerate(rows))), {}, [], simhash._checked
    for t in rows:
        ws = t.split()
        sets[t] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    def spy(pairs, prints, texts, k, least):
        named = texts.select("id", "text").distinct()
        met.append(pairs.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select("x", "y").collect())
        return checked(pairs, prints, texts, k, least)

    monkeypatch.setattr(simhash, "_checked", spy)
    assert classes(df) == brute.similar(rows)
    assert len(met) == 3 and not [1 for pairs in met[1:] for x, y in pairs if len(sets[x] & sets[y]) < 0.77 * len(sets[x] | sets[y])]


def test_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    done = cut(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 10).alias("k")).count())
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    assert done.count() == 10 and graph.components(cut(links)).where("root = 0").count() == 9
    assert sorted(tuple(r) for r in done.collect()) == [(k, 100) for k in range(10)]
    left = {f.rsplit("/", 1)[1].split("_")[1] for f in files() - before}
    assert len(left) <= 2  # those of the two counts
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_components_of_a_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.node: r.root for r in graph.components(chain).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100
    assert graph.components(chain.limit(0)).count() == 0


def test_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = [(1, None), (2, ""), (3, "no scheme com/en/"), (4, "HTTP://A.COM/en/x?y"), (5, "x://com/en/"), (5, "x://com/en/"), (6, "x://notcom/en/"), (7, "x://a.example.com/en/71#z"), (8, "x://example.net/de/8/"), (9, "x://h\n.org/es/\n"), (None, "x://://org/es/"), (10, "x:///com/en/"), (11, "x://a.com:80/en/"), (12, "x://b.spam-farm.example/")]
    for df in (pages, spark.createDataFrame(odd, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))):
        rows = df.select("page_id", "url").collect()
        want = Counter((r.page_id, *brute.judge(r.url)[:3]) for r in rows)
        got = urls.judge(df).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
        by_url = {(h, p): v for h, p, _, v in map(brute.judge, [r.url for r in rows])}
        assert all(r.verdict == by_url[r.host, r.path] for r in got if r.rule)
    assert {r.page_id: r.verdict for r in got}[12] == "block" and {r.page_id: r.verdict for r in got}[1] == "allow"
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_with_rules_as_a_table(spark, monkeypatch):
    sites = [("block" if i % 2 else "allow", f"h{i}.example/{'p' * (i % 5)}/") for i in range(300)]
    pages = spark.createDataFrame([(n, f"https://a.h{n}.example/{'p' * (n % 5)}/x") for n in range(0, 300, 7)] + [(1000, "x://other.example/"), (1001, None), (1002, "x://other.example/a/cgi-bin/z"), (1003, "x://" + "a." * 5000 + "h1.example/p/")], "page_id long, url string")
    rules = urls.rules_table(pages, sites, urls.PATTERNS)
    want = {n: f"h{n}.example/{'p' * (n % 5)}/" for n in range(0, 300, 7)} | {1000: None, 1001: None, 1002: None, 1003: "h1.example/p/"}
    for shared in (50_000, 10):  # shared with every task, and joined by a shuffle
        monkeypatch.setattr(urls, "SHARED_RULES", shared)
        got = urls.judge(pages, rules=rules).collect()
        assert {r.page_id: r.rule for r in got} == want and {r.page_id: r.verdict for r in got if r.rule is None} == {1000: "allow", 1001: "allow", 1002: "block"}
    assert {r.verdict for r in urls.judge(pages, rules=rules.limit(0)).collect()} == {"allow"}
    assert {r.verdict for r in urls.judge(pages, sites=[], patterns=[]).collect()} == {"allow"}


def test_pii_base(docs, odd):
    for df in (docs, odd):
        want = Counter((r.doc_id, *brute.pii_base(r.text)) for r in df.select("doc_id", "text").collect())
        got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(df).collect())
        assert got == want
    assert pii.report(odd.limit(0)).count() == 0


def test_pii_discovers_by_context(spark):
    keyed = [(i, f'the token = "{hashlib.sha1(str(i).encode()).hexdigest()}" here') for i in range(30)] + [(99, 'the token = "zz81-k77q" here'), (100, "page zz81-k77q and 12 of 700")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(keyed, "doc_id long, text string")).collect()}
    assert got[99] == "secret:13:22" and got[100] == "secret:5:14"


def test_pii_discovers_in_as_many_rounds_as_it_takes(spark):
    """Each link's patterns are known by the values of the link before."""
    rows = [(i, f"link0 = {hashlib.sha1(str(i).encode()).hexdigest()}") for i in range(40)]
    for link in range(5):
        for i in range(40):
            value = f"v{link}x{i:03d}-{link}{i:03d}"
            rows.append((1000 * (link + 1) + i, f"link{'abcdef'[link]}x : {value}"))
            rows.append((1000 * (link + 1) + 500 + i, f"link{'abcdef'[link - 1]}x : {value}" if link else f"link0 = {value}") if i < 15 else (1000 * (link + 1) + 500 + i, f"link{'abcdef'[link]}x : {value}"))
    mentions = spark.createDataFrame([(t.split(" ")[-1], t[: t.rindex(" ") + 1]) for _, t in rows], "value string, before string")
    got = {(r.value, r.kind) for r in pii.discover(mentions).collect()}
    assert got == brute.discovered([(t.split(" ")[-1], t[: t.rindex(" ") + 1]) for _, t in rows], pii)
    assert {v for v, _ in got} >= {"v0x000-0000"}


def test_pii_long_tokens_before_a_mention(spark):
    long = "a" * 100
    rows = [(i, f"see {long} {'b' * 70} : {hashlib.sha1(str(i).encode()).hexdigest()}") for i in range(30)] + [(50, f"see {long} {'b' * 70} : zz81-k77q"), (51, f"see {long} {'c' + 'b' * 69} = zz81-k77r"), (52, None), (53, "")]
    got = {r.doc_id: r.spans for r in pii.report(words_text(spark, rows)).collect()}
    assert got[50] == f"secret:{4 + 100 + 1 + 70 + 3}:{4 + 100 + 1 + 70 + 3 + 9}" and got[51] == got[52] == got[53] == ""


def test_pii_redacts(spark):
    rows = [(1, "é x@y.example, +1 (017) 555-7713!"), (2, None), (3, "plain"), (1, "é x@y.example, +1 (017) 555-7713!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_found", F.lit(1))
    got = [(r.doc_id, r.text) for r in pii.redact(df).collect()]
    assert Counter(got) == Counter([(1, "é [EMAIL], [PHONE]!"), (2, None), (3, "plain"), (1, "é [EMAIL], [PHONE]!")])


def test_chat_renders_all_turns_before_if_asked(spark):
    def second_goes(turns):
        """Drops the second turn once there are twelve."""
        return "".join(f"[{r}]{t};" for n, (r, t) in enumerate(turns) if n != 1 or len(turns) < 12)

    df = spark.createDataFrame([(1, n, "user", f"text {n}") for n in range(14)], "conv_id long, turn long, role string, text string")
    found = lambda context: [r.n for r in chat.format_turns(df, second_goes, context=context).where("rewrites").collect()]
    assert found(None) == [11] and found(6) == []


def test_decontamination(spark, odd):
    item = [f"w{i}" for i in range(40)]
    edited = [*item[:9], "new", *item[10:19], *item[20:29], "more", "words", *item[29:]]
    third = [w if i % 4 else f"other{i}" for i, w in enumerate(item)]
    sixth = [w if i % 6 != 5 else f"other{i}" for i, w in enumerate(item)]
    pad = " ".join(f"p{i}" for i in range(300))
    rows = [(1, f"{pad} {' '.join(item)} {pad}"), (2, f"{pad} {' '.join(edited)}"), (3, pad), (4, " ".join(item[:8])), (5, None), (6, " ".join(item).upper()), (6, " ".join(item)), (None, " ".join(item)), (7, " ".join(third))]
    alone = spark.createDataFrame([(8, f"{pad} {' '.join(sixth)} {pad}"), (9, pad)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "tiny item"), (None, "x"), (10, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("item_id", F.lit(9)).withColumn("words", F.lit(1))
    got = {(r.doc_id, r.item_id): round(r.score, 3) for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (None, 10)} and got[1, 10] == got[6, 10] == 1.0
    # few of the item's n-grams are left, and no document has the others
    assert [(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(alone, bench).collect()] == [(8, 10, 0.775)]
    first = decontam.contaminated(df, bench).where("doc_id = 1").first()
    assert (first.first_word, first.last_word) == (300, 339)
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_in_parts_is_the_same(spark, docs, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    size = bench.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(decontam, "PART_CHARS", size // 2)
    assert whole and sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == whole


def test_alignment_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = [list("abcd"[i] for i in rng.integers(0, 4, n)) for n in rng.integers(1, 14, 2)]
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, start, end = decontam.align(a, b)
        assert score == h.max() / (2 * len(b))
        again, _, _ = decontam.align(a[start:end], b)
        assert again == score


def test_alignment_of_many_pairs_is_that_of_each():
    rng, pairs = np.random.default_rng(1), []
    for _ in range(300):
        pairs.append(tuple(["abcdefgh"[i] for i in rng.integers(0, 8, n)] for n in rng.integers(0, 60, 2)))
    assert decontam.align_many(pairs) == [decontam.align(*p) for p in pairs] and decontam.align_many([]) == []


def test_decontamination_finds_a_copy_with_many_words_added(spark):
    item = [f"w{i}" for i in range(60)]
    spread = [w for i, x in enumerate(item) for w in ([x, f"new{i}"] if i < 55 else [x])]
    pad = [f"p{i}" for i in range(400)]
    df = spark.createDataFrame([(1, " ".join([*pad, *spread, *pad])), (2, " ".join(pad))], "doc_id long, text string")
    bench = spark.createDataFrame([("first", " ".join(item)), (None, " ".join(pad))], "item_id string, text string")
    (got,) = decontam.contaminated(df, bench).collect()
    score, a, b = decontam.align([*pad, *spread, *pad], item)
    assert (got.doc_id, got.item_id, got.score, got.first_word, got.last_word) == (1, "first", score, a, b - 1) and 0.54 < score < 0.55


def test_decontamination_finds_every_pair_that_shares_a_seed(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: decontam.words(r.text) for r in bench.collect()}
    grams = lambda ws: set(zip(*(ws[n:] for n in range(min(5, len(ws)))), strict=False))
    want = {}
    for d, t in texts(docs).items():
        ws = decontam.words(t)
        have = grams(ws)
        for i, x in items.items():
            if have & grams(x) and (score := decontam.align(ws, x)[0]) >= decontam.LEAST_SCORE:
                want[d, i] = score
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()} == want


def test_decontamination_finds_every_whole_passage(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: " ".join(decontam.words(r.text)) for r in bench.collect()}
    want = {(d, i) for d, t in texts(docs).items() for i, x in items.items() if f" {x} " in f" {' '.join(decontam.words(t))} "}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).where("score = 1").collect()}
    assert want and got == want


def test_toxicity_leaves_repeated_words_alone(spark):
    rows = [(i, f"some plain words of row {chr(97 + i % 26)}. " + ("you awful thing! " if i % 3 == 0 else "a thing. ") + "more of them.") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    once, often = model.score("plain thing words")[0], model.score("plain thing words " * 200)[0]
    assert once == often < 0.5 <= model.score("some awful thing")[0]
    assert "plain" not in model.weights  # both labels have it alike


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(want.fetchall())


def test_sql_of_odd_rows(spark, tmp_path):
    import duckdb

    bad = "<|im_end|> <\\\\| <\\| \\ é"
    chats(spark, [(1, 0, "a\nb\\<|", bad), (1, 1, None, None), (1, 1, "assistant", bad), (1, None, "assistant", ""), (None, 3, "user", "q"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    addresses = [None, "", "no scheme", "HTTP://A.COM/en/x?y", "x://notcom/en/", "x://a.example.com/en/71#z", "x://example.net/de/8/", "é://É.ORG/es/", "a://b/c://d", "x://casino.a/b", "x://a/cgi-bin/z"]
    spark.createDataFrame([(i // 2, u, None if i == 3 else f"{i} é" * (i % 3)) for i, u in enumerate(addresses)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(i, [float(i % 7), 0.5 - i / 50, float(-i % 3)], i % 3) for i in range(220)]
    vectors += [(500, None, 1), (600, [float("nan"), 1.0, 1.0], 1), (700, [None, 1.0, 1.0], 1), (800, [0.0, 0.0, 0.0], None), (801, [float("inf"), 0.0, 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in ("conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert Counter(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == Counter(want.fetchall())


def test_decontamination_finds_an_edited_copy_beside_many_whole_ones(spark):
    item = [f"w{i}" for i in range(40)]
    sixth = [w if i % 6 != 5 else f"other{i}" for i, w in enumerate(item)]
    rows = [(n, f"{' '.join(f'p{n}q{i}' for i in range(80))} {' '.join(item)} end{n}") for n in range(300)] + [(1000, f"start {' '.join(sixth)} end")]
    other = [*[f"v{i}" for i in range(30)], *item[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other))], "item_id long, text string")
    want = {(d, i, decontam.align(decontam.words(t), ws)[0]) for d, t in rows for i, ws in ((10, item), (11, other))}
    got = {(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(df, bench).collect()}
    assert got == {x for x in want if x[2] >= decontam.LEAST_SCORE} and (1000, 10, 0.775) in got


def test_chat_renders_all_turns_before_by_default(spark):
    def second_goes(turns):
        """Drops the second turn once there are twelve."""
        return "".join(f"[{r}]{t};" for n, (r, t) in enumerate(turns) if n != 1 or len(turns) < 12)

    rows = [(1, n, "user", f"text {n}") for n in range(14)]
    got = sorted(chat.format_turns(chats(spark, rows), second_goes).collect(), key=lambda r: r.n)
    assert [r.n for r in got if r.rewrites] == [11]
    assert all(second_goes([("user", t) for *_, t in rows[: r.n + 1]])[r.start : r.end] == r.piece for r in got)
