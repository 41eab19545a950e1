"""URL rules, WARC, chat, classifiers and tokens."""

import gzip
import hashlib
import json
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, langid, quality, url_filter, warc
from graphloom.llm import queries as Q
from graphloom.llm import textkernel as K
from graphloom.llm.queries import URL_RULES
from graphloom.llm.shared import below, crc_fold, sampled_texts

# --- urls


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_both_ways_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["EXAMPLE.com", "a.example.net", "example.net", "xexample.net", "net", "b.c.org", "org", "example.com:80", "", "é.NET", "."]
    urls = [None, "", "no scheme", "http://", "http://net", "http://net?x://org/fr/", "a://b://net/"]
    urls += [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/de/', '/fr/x?q#f', '/en', '?a/b', '#/en/', '//en/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    want = sorted(map(str, [(i, *brute_url(u)) for i, u in enumerate(urls)]))
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    for given, size in ((URL_RULES, 1 << 20), (URL_RULES, 1 << 20), (rules, 1 << 20), (rules, 1)):
        out = url_filter.judge_urls(pages, given, max_index_bytes=size).collect()
        assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out])) == want
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert url_filter.judge_urls(pages, []).where("verdict = 'allow'").count() == len(urls)


def test_a_digest_collision_does_not_decide(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    url_filter.DigestArray.write(str(tmp_path / "x"), [("a/", "block"), ("b/", "allow"), ("c/d", "block")])
    index = url_filter.DigestArray(str(tmp_path / "x"))
    found = index.probe([b"b/", b"z/", b"c/d", b"a/"])
    assert [index.string(i) if i >= 0 else None for i in found] == [b"b/", None, b"c/d", b"a/"]
    with pytest.raises(ValueError):
        url_filter.DigestArray.write(str(tmp_path / "y"), [("a/", "block"), ("a/", "allow")])


def test_both_ways_refuse_the_same_rules_and_keep_clashing_columns(spark):
    pages = spark.createDataFrame([("http://a.net/x", 1, 2, 3, 4)], "url string, _row int, _cand int, c0 int, wanted int")
    for size in (1 << 20, 1):
        for bad in ([("a/", "block"), ("A/", "allow")], [("nothing", "block")]):
            with pytest.raises(ValueError):
                url_filter.judge_urls(pages, spark.createDataFrame(bad, "rule string, verdict string"), max_index_bytes=size)
        r = url_filter.judge_urls(pages, spark.createDataFrame([("NET/", "block")], "rule string, verdict string"), max_index_bytes=size).first()
        assert (r._row, r._cand, r.c0, r.wanted, r.host, r.rule, r.verdict) == (1, 2, 3, 4, "a.net", "net/", "block")


# --- WARC


class Visible(HTMLParser):
    """An independent text extractor."""

    hidden = {"script", "style", "noscript", "template", "title", "head"}
    block = warc._BLOCK

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth, self.links, self.title, self.inside = [], 0, [], [], False

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden
        self.inside |= tag == "title"
        if tag == "a" and "href" in dict(attrs):
            self.links.append(dict(attrs)["href"] or "")
        if tag in self.block:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.hidden
        self.inside &= tag != "title"
        if tag in self.block:
            self.out.append("\n")

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)
        if not self.depth:
            self.out.append(data.replace("\n", " "))

    def text(self):
        rows = [" ".join(r.split()) for r in "".join(self.out).split("\n")]
        return "\n".join(r for r in rows if r)


def test_plain_text_of_all_pages_against_a_parser(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect():
        v = Visible()
        v.feed(r.html)
        v.close()
        assert " ".join(warc.plain_text(r.html).split()) == " ".join(v.text().split())


def test_metadata_of_all_pages_against_a_parser(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r for r in pages.collect()}
    out = warc.derivatives(warc.responses_of_pages(pages), ["page_id"]).where("record_type = 'metadata'").collect()
    assert len(out) == len(html)
    for r in out:
        v = Visible()
        v.feed(html[r.page_id].html or "")
        v.close()
        meta = json.loads(r.block)
        assert meta["links"] == v.links and meta["title"] == " ".join("".join(v.title).split())
        assert meta["source"]["WARC-Record-ID"] == r.refers_to and meta["source"]["WARC-Target-URI"] == (html[r.page_id].url or "") == r.target_uri
        assert meta["source"]["WARC-Type"] == "response" and meta["source"]["WARC-Payload-Digest"] == warc.digest((html[r.page_id].html or "").encode()) == r.payload_digest
        assert meta["http"]["Content-Length"] == str(len((html[r.page_id].html or "").encode())) and meta["status"] == "HTTP/1.1 200 OK"


def test_odd_markup_is_scanned_once_and_in_linear_time():
    cases = {
        "<p>a<script>x<b>y</SCRIPT >z": ("az", "", []),
        "1 < 2 <3 <b>x</b": ("1 < 2 <3 x</b", "", []),
        "<head><title>T</title><body>open head": ("open head", "T", []),
        "<a href=x>l</a><A HREF='y\">&amp;'>m</A><a name=n>o<a href>p": ("lmop", "", ["x", 'y">&', ""]),
        "a<!-- <p> -->b<!doctype x>c<?pi?>d<!-- open": ("abcd", "", []),
        "<a title='>' href=\"q\">r": ("r", "", ["q"]),
        "İ<title>İ</TITLE>x": ("İx", "İ", []),
        "": ("", "", []),
    }
    for page, want in cases.items():
        assert warc.read_page(page) == want, page
    for unit in ("<a ", "<a '", '<a ">', "<a href=", "<", "<!--", "<!", "</", "<script>", "<title><", "<a b", "<a \t", "&lt", "<p'\">"):
        page = unit * (1_000_000 // len(unit))
        for tail in ("", ">", "'>", '">'):
            began = time.process_time()
            warc.read_page(page + tail)
            assert time.process_time() - began < 4, (unit, tail)


def test_payloads_are_decoded_as_their_headers_say(spark, tmp_path):
    body = "<p>Grüße, naïve</p>".encode("latin-1")
    chunk = lambda b: b"".join(b"%x\r\n%s\r\n" % (len(b[i : i + 7]), b[i : i + 7]) for i in range(0, len(b), 7)) + b"0\r\n\r\n"
    heads = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1"
    blocks = [
        heads + b"\r\n\r\n" + body,
        heads + b"\r\nTransfer-Encoding: chunked\r\n\r\n" + chunk(body),
        heads + b"\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunk(gzip.compress(body)),
        heads + b"\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(body),
        b"HTTP/1.1 200 OK\r\n\r\n<meta charset='latin-1'>" + body,
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n" + "<p>Grüße, naïve</p>".encode(),
    ]
    raw = b"".join(warc.to_warc({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, b) for i, b in enumerate(blocks))
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.to_warc({"WARC-Type": "response"}, b)) for b in blocks))
    for by_path in (False, True):
        rows = warc.read_responses(spark, str(tmp_path), by_path=by_path).collect()
        assert len(rows) == 12 and {warc.plain_text(r.payload) for r in rows} == {"Grüße, naïve"}
        assert sum(r.digest == warc.digest(body) for r in rows) == 4  # a content coding is part of the payload
    made = warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()
    assert sum(r.payload_digest == warc.digest(body) for r in made) == 8
    with pytest.raises(ValueError):
        warc.derivatives(warc.responses_of_pages(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")).withColumn("block", F.lit(1)), ["block"])


def test_derivatives_link_back_and_survive_files(spark, tmp_path):
    rows = [(1, "http://a/", "<title>T &amp; x</title><p>Hi<br>there</p><a href='/u'>l</a>"), (2, None, None), (1, "http://a/", "<p>unclosed <script>var x"), (4, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    responses = warc.responses_of_pages(pages)
    out = warc.derivatives(responses, ["page_id"]).collect()
    assert len(out) == 8 and sorted({r.record_type for r in out}) == ["conversion", "metadata"]
    ids = {r.record_id for r in responses.collect()}
    assert all(r.refers_to in ids and r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode()) for r in out)
    assert next(r.block for r in out if r.record_type == "conversion" and "Hi" in r.block) == "Hi\nthere\nl"
    assert all(r.payload_digest.startswith("sha1:") and len(r.payload_digest) == 37 for r in out)
    raw = b"".join(warc.to_warc({"WARC-Type": "response", "WARC-Record-ID": r.record_id, "WARC-Target-URI": r.target_uri, "WARC-Date": r.warc_date, "WARC-Payload-Digest": "sha1:KEPT"}, (r.http + "\r\n\r\n" + r.payload).encode()) for r in responses.collect())
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw))
    back = warc.read_responses(spark, str(tmp_path))
    again = warc.derivatives(back).collect()
    assert len(again) == 8 and {r.payload_digest for r in again} == {"sha1:KEPT"}
    made = warc.with_bytes(warc.derivatives(back)).select("warc", "block").collect()
    assert all(next(warc.parse_warc(bytes(r.warc)))[1] == r.block.encode() for r in made)
    assert warc.derivatives(responses.limit(0)).count() == 0


# --- chat


def test_rotation_of_odd_conversations(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", "yo"), (1, 600, "ann", "late"), (2, None, None, "x"), (None, 0, "ann", "n"), (3, 0, "system", "only")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, participant string")
    out = {(r.conv_id, r.participant, r.segment): r for r in chat.rotate(df).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (2, "unknown", 0), (None, "ann", 0)}
    r = out[1, "bob", 0]
    assert r.rendered == "<|begin|>system\nS<|end|>\n<|begin|>user name=ann\nhi<|end|>\n<|begin|>assistant\n<|end|>\n<|begin|>assistant\nyo<|end|>\n"
    assert [r.rendered[s.begin : s.end] for s in r.mask] == ["<|end|>", "yo<|end|>"] and (r.n_turns, r.n_target_turns) == (4, 2)
    assert out[1, "bob", 1].mask == [] and chat.rotate(df.limit(0)).count() == 0


# --- quality classifier


def test_subword_features_stay_inside_their_text():
    texts = ["ab cd", "", "xyz  ab", "é"]
    data, offsets = K.flat(pa.array(texts))
    ids, bounds = quality.hashed(data, offsets)
    for i, t in enumerate(texts):
        alone, _ = quality.hashed(*K.flat(pa.array([t])))
        assert sorted(ids[bounds[i] : bounds[i + 1]].tolist()) == sorted(alone.tolist())


def test_quality_scores_separate_and_cover_all_rows(spark, docs, rows):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "stone", "walk", "green"]) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["w!!", "x$$", "BUY"]) for _ in range(60)) for _ in range(60)]
    model = quality.train(good + bad, np.array([1] * 60 + [0] * 60), epochs=3)
    data, offsets = K.flat(pa.array(good[:5] + bad[:5]))
    score = model.scores(data, offsets)
    assert score[:5].min() > 0.9 and score[5:].max() < 0.1
    out = quality.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    flat = quality.train([], np.array([], int))
    assert flat.scores(*K.flat(pa.array(["a", None]))).tolist() == [0.5, 0.5]


def _folded(spark, small, tmp_path, name, change):
    """The tables of ``small`` with one of them changed."""
    for table in ("documents", "labels"):
        df = spark.read.parquet(f"{small}/{table}.parquet")
        (change(df) if table == name else df).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_quality_learns_nothing_from_held_out_labels_nor_from_ids(spark, small, tmp_path):
    plain = {r.doc_id: r for r in Q.op8_quality_classifier(spark, small).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for i, r in plain.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [i for i, y in labels.items() if plain[i].held_out and y in (0, 1)]
    assert sum(plain[i].predicted == labels[i] for i in held) / len(held) > 0.8
    turned = lambda df: df.withColumn("quality", F.when(crc_fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r.doc_id: r.score for r in Q.op8_quality_classifier(spark, _folded(spark, small, tmp_path, "labels", turned)).collect()}
    assert other == {i: r.score for i, r in plain.items()}


def test_scores_are_the_mean_of_what_was_learned(spark):
    model = quality.train(["good words here", "bad##words!!", "more good text", "b## b##"], np.array([1, 0, 1, 0]), epochs=2)
    texts = ["good bad", "", None, "x " * 5000, "é ##"]
    out = quality.scored(spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "id int, text string, score double"), model).collect()
    for r in out:
        ids, _ = quality.hashed(*K.flat(pa.array([texts[r.id]], pa.string())))
        mean = float(np.mean([float(model.table[k]) for k in ids])) if len(ids) else 0.0
        assert abs(r.score - 1 / (1 + np.exp(-mean - model.prior))) < 1e-6
    assert len(out) == 5


def test_samples_never_run_empty_and_are_bounded_in_bytes(spark):
    for n in (10**5, 10**9, 10**11, 10**15):
        share = 1600 / n
        assert abs((below(share) + 2**63) / 2**64 / share - 1) < 1e-2
    assert below(1.0) == 2**63 - 1
    rows = spark.createDataFrame([(i, i % 2, "x" * (10**6 if i == 3 else 1000)) for i in range(40)] * 3 + [(50, 1, None)], "k long, l int, text string")
    got = sampled_texts(rows, "k", "l", max_bytes=20_000)
    assert len(got) == 21 and set(got["text"].str.len().dropna()) == {1000.0} or set(got["text"].dropna().map(len)) == {1000}
    assert len(sampled_texts(rows, "k", "l")) == 41


# --- language


def test_language_learns_nothing_from_held_out_rows(spark, small, tmp_path):
    plain = {r.doc_id: r for r in Q.op10_language_id(spark, small).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in plain.items())
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [i for i, y in lang.items() if y and plain[i].held_out and plain[i].lang_pred != "und"]
    assert sum(plain[i].lang_pred == lang[i] for i in held) / len(held) > 0.9
    turned = lambda df: df.withColumn("lang", F.when(crc_fold("doc_id", 5) == 0, F.lit("zz")).otherwise(F.col("lang")))
    other = {r.doc_id: (r.lang_pred, r.score) for r in Q.op10_language_id(spark, _folded(spark, small, tmp_path, "documents", turned)).collect()}
    assert other == {i: (r.lang_pred, r.score) for i, r in plain.items()}


def test_a_rare_language_is_learned(spark):
    common = [(i, "the house of the river and the stone " * 3, "en") for i in range(3000)]
    rare = [(10_000 + i, "das ist der fluss und ein stein nicht " * 3, "de") for i in range(8)]
    tagger = langid.train_on(spark.createDataFrame(common + rare + [(None, "x", "fr"), (1, None, "it"), (2, "y", None)], "doc_id long, text string, lang string"), sample_rows=100)
    assert tagger.labels == ["de", "en"]


def brute_chain(em, first, moves):
    k = em.shape[1]
    out = np.zeros(em.shape)
    pairs = np.zeros((k, k))
    T, E = np.exp(moves), np.exp(em)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        alpha, beta = np.zeros((b - a + 1, k)), np.ones((b - a + 1, k))
        alpha[0] = 1 / k
        for t in range(b - a):
            alpha[t + 1] = (alpha[t] @ T) * E[a + t]
        for t in range(b - a, 0, -1):
            beta[t - 1] = T @ (E[a + t - 1] * beta[t])
        z = alpha[-1].sum()
        out[a:b] = alpha[1:] * beta[1:] / z
        for t in range(b - a):
            pairs += alpha[t][:, None] * T * (E[a + t] * beta[t + 1])[None] / z
    return out, pairs


def test_forward_backward_in_blocks_is_exact():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 5, 23, 0, 40, 16]
    first = np.cumsum([0, *lengths])
    em = rng.normal(size=(first[-1], 3)).astype(np.float32)
    moves = rng.normal(size=(3, 3)).astype(np.float32)
    want, pairs = brute_chain(em.astype(float), first, moves.astype(float))
    for block in (4, 8, 512):
        got, total = langid.forward_backward(em, first, moves, pairs=True, block=block)
        assert np.allclose(got, want, atol=1e-4) and np.allclose(total, pairs, atol=1e-3)


def test_equal_words_are_worked_out_once_and_exactly(monkeypatch):
    texts = ["the cat the cat  the", "", "él 1a él, a the a", None, "x", "the" * 40 + " " + "the" * 41] * 3
    data, offsets = K.flat(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(4)
    tagger = langid.Tagger(["a", "b"], rng.normal(size=(langid.BUCKETS + 2, 2)).astype(np.float32), np.zeros((2, 2), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for flat in (False, True):
        if flat:  # all hashes collide: bytes decide
            monkeypatch.setattr(K, "span_hashes", lambda data, starts, ends, which=0: np.zeros(len(starts), np.uint64))
        w = langid.Words(data, offsets)
        word, slot = w.pairs(np.full(len(w.starts), -1))
        want = np.zeros((len(w.starts), 2))
        np.add.at(want, word, tagger.weights[slot].astype(float))
        seen, grams = [], langid.Words.grams
        monkeypatch.setattr(langid.Words, "grams", lambda self, i, j, order, f=grams: seen.append(j - i) or f(self, i, j, order))
        assert np.allclose(tagger.emissions(w), want, atol=1e-4)
        monkeypatch.setattr(langid.Words, "grams", grams)
        assert seen == [len({bytes(w.clean[a + 1 : b + 1]) for a, b in zip(w.starts, w.ends, strict=True)})] * len(langid.ORDERS)
        alone = np.concatenate([tagger.emissions(langid.Words(*K.flat(pa.array([t], pa.large_string())))) for t in texts])
        assert np.allclose(alone, want, atol=1e-4)  # whatever other texts the batch holds
    assert tagger.emissions(langid.Words(*K.flat(pa.array([None, "1"], pa.large_string())))).shape == (0, 2)


def test_language_of_whole_and_odd_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tagger = langid.train_on(docs.where("doc_id % 2 = 0"))
    out = langid.identified(docs.select("doc_id", "text", "lang"), tagger).where("doc_id % 2 = 1").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 --- \u20ac \u2014"), (4, "日本"), (5, "the of and")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score, r.word_langs) for r in langid.identified(odd, tagger, with_words=True).collect()}
    assert [got[i][:2] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] != "und" and len(got[5][2]) == 3
    assert langid.identified(odd, langid.train([], [])).where("lang_pred = 'und'").count() == 5


# --- tokens


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, bpe.Codec(ranks, public_tokenizers.PATTERN), own


def test_transducer_gives_the_tokens_of_the_merges(tokenizer):
    ranks, codec, own = tokenizer
    rng = random.Random(5)
    pool = list(ranks)
    for _ in range(1500):
        piece = b"".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))
        assert codec.machine.encode(piece) == own._encode_single_piece(piece)
        text = "".join(rng.choice("abcdefghist  aeiouéñ中\n\t12 '😀ZX!?#") for _ in range(rng.randrange(60)))
        assert codec.encode(text) == own.encode_ordinary(text)
    for piece in (b"abcdefg" * 300, b"a" * 5000, bytes(range(256)) * 4):
        assert list(codec.machine.stream(piece)) == codec.machine.encode(piece) == bpe.merge_by_rank(ranks, piece)


def test_states_are_forgotten_without_harm(tokenizer, monkeypatch):
    ranks, _, own = tokenizer
    monkeypatch.setattr(bpe, "MOVE_MEMO", 50)
    monkeypatch.setattr(bpe, "PIECE_MEMO", 3)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = "unrelated wordings of transducers, again and again: wordings"
    assert codec.encode(text) == own.encode_ordinary(text)


def test_frequent_pieces_stay_known_among_many_rare_ones(tokenizer, monkeypatch):
    ranks, _, own = tokenizer
    monkeypatch.setattr(bpe, "PIECE_MEMO", 10)
    monkeypatch.setattr(bpe, "MOVE_MEMO", 200)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    made, encode = [], codec.machine.encode
    monkeypatch.setattr(codec.machine, "encode", lambda piece: made.append(piece) or encode(piece))
    text = "".join(f" the w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(200))
    assert codec.encode(text) == own.encode_ordinary(text)
    assert codec.encode(text[:400]) == own.encode_ordinary(text[:400])
    assert made.count(b" the") <= 2
    assert max(len(codec.machine.pieces), len(codec.machine.older)) <= 10


def test_pairs_are_judged_as_the_merges_do(tokenizer):
    rng = random.Random(6)
    vocabularies = [tokenizer[0]]
    for k in range(60):
        pool = [bytes([c]) for c in rng.sample(b"abc", 3)]
        for _ in range(30):
            pool.append(rng.choice(pool) + rng.choice(pool))
        pool = list(dict.fromkeys(t for t in pool if len(t) < 12))
        if k % 3 == 0:  # merges out of order
            rng.shuffle(pool)
        vocabularies.append({t: i for i, t in enumerate(pool)})
    for ranks in vocabularies:
        machine = bpe.Transducer(ranks)
        pool = list(machine.text)
        for _ in range(300):
            a, b = rng.choice(pool), rng.choice(pool)
            assert machine.fits(a, b) == (bpe.merge_by_rank(ranks, machine.text[a] + machine.text[b]) == [a, b])


def test_streaming_decoder_holds_back_cut_characters(tokenizer):
    ranks, codec, _ = tokenizer
    text = "é日本😀 plain 😀é"
    ids = codec.encode(text)
    parts = [[i] for i in ids]
    out = list(codec.decode_stream(parts))
    assert "".join(out) == text and "\ufffd" not in "".join(out)
    lone = bpe.StreamDecoder([bytes([b]) for b in range(256)])
    assert lone.feed([0xE2, 0x82]) == "" and lone.feed([0x41]) == "\ufffdA" and lone.feed([0xFF, 0xC3]) == "\ufffd" and lone.finish() == "\ufffd"


def test_documents_round_trip(spark, docs, rows, tokenizer):
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=True).collect()
    own = tokenizer[2]
    want = sorted((str(r[0]), len(i := own.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), r[1] or "") for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in out) == want
