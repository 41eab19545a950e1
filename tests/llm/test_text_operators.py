"""Operators that count or compare texts, against plain Python over the same rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import decision_list, simhash, substring, winnowing
from graphloom.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# --- kernel


@given(st.lists(st.text(alphabet="ab é\n\t\u00a0\u2003日😀", max_size=30), max_size=12))
@settings(max_examples=60, deadline=None)
def test_words_and_lines_of_the_kernel(texts):
    data, offsets = K.flat(pa.array(texts, pa.string()))
    starts, ends, first = K.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[starts[j] : ends[j]].decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]
    a, b, of = K.lines(data, offsets)
    assert [[raw[a[j] : b[j]].decode() for j in range(of[i], of[i + 1])] for i in range(len(texts))] == [t.split("\n") for t in texts]
    h = K.span_hashes(data, starts, ends)
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(set(h.tolist())) == len(set(flat))
    for k in (2, 3, 5, 8):
        grams = K.ngram_hashes(h, k)
        assert len(set(grams.tolist())) == len({tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)})


def test_slices_of_null_columns_and_offsets():
    column = pa.array(["ab", None, "", "cd ef"])[1:]
    data, offsets = K.flat(column)
    assert data.tobytes() == b"cd ef" and offsets.tolist() == [0, 0, 0, 5]
    assert [x.tolist() for x in K.flat(pa.array([], pa.string()))] == [[], [0]]
    assert list(K.slices(np.array([0, 9, 9, 20]), 5)) == [(0, 1), (1, 2), (2, 3)]


# --- quality rules


def brute_counts(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_counts_of_every_text(docs, rows):
    got = decision_list.with_counts(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(r[1]), *brute_counts(r[1])) for r in rows)


def test_rules_are_learned_and_agree_with_their_sql(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(f"w{rng.integers(900)}" for _ in range(80)) for _ in range(150)]
    bad = [" ".join(f"w{rng.integers(900)}#$" for _ in range(80)) for _ in range(60)]
    data = [(i, t) for i, t in enumerate([*good, *bad])]
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(3, None), (None, 1)], "doc_id long, quality int")
    rules = decision_list.learn_rules(d, labels)
    assert rules
    kept = {r.doc_id: r.kept for r in decision_list.judged(d, rules).collect()}
    assert all(kept[i] == (i < 150) for i in range(210))
    x = {n: np.arange(10.0) for n in decision_list.FEATURES}
    assert decision_list.learn(x, np.zeros(10, bool)) == []


def test_without_labels_only_the_base_rule_rejects(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rules = decision_list.learn_rules(docs, none)
    assert rules == []
    out = decision_list.judged(docs, rules)
    assert out.where("kept = base_failed").count() == 0 and out.where("n_words = 0 and kept").count() == 0


# --- SimHash


def brute_print(t):
    w = WORD.findall(low(t or ""))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, radius):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def brute_groups_of_links(links, values):
    group = {v: v for v in values}
    for a, b in links:
        low, high = sorted((group[a], group[b]))
        group = {v: low if g == high else g for v, g in group.items()}
    return group


def test_covering_masks_meet_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(diff & m == 0 for m in masks)


def test_near_duplicates_against_all_pairs(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(r[1]) for r in rows]
    group = brute_groups(prints, 4)
    low_id = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            low_id[group[p]] = min(low_id.get(group[p], 1 << 60), r[0])
    want = [(r[0], f"{p:016x}", low_id.get(group[p])) for r, p in zip(rows, prints, strict=True)]
    assert sorted(map(str, [(g.doc_id, g.fingerprint, g.component_id) for g in got])) == sorted(map(str, want))


def test_large_cells_take_the_other_way_and_lose_no_link(spark):
    rng = np.random.default_rng(2)
    center = int(rng.integers(1 << 62))
    values = {center}
    for _ in range(300):
        v = center
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    df = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "fp long")
    want = brute_groups(values, 4)
    for cell in (4096, 8):
        links = simhash.links_within(df, 4, cell).collect()
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
        got = {v: v for v in values}
        for _ in range(40):
            for a, b in links:
                x, y = a % (1 << 64), b % (1 << 64)
                got[x] = got[y] = min(got[x], got[y])
        assert len(set(got.values())) == len(set(want.values()))


def test_cells_link_across_the_highest_bit_and_no_farther():
    rng = np.random.default_rng(4)
    cases = [[0, 0x80000000, 0x8000000000000001], [0, 0xF800000000000000, 0x80000000]]
    for _ in range(200):
        values = {center := int(rng.integers(1 << 63))}
        for _ in range(rng.integers(2, 10)):
            v = center ^ int(rng.integers(2)) << 63
            for b in rng.choice(63, rng.integers(0, 6), replace=False):
                v ^= 1 << int(b)
            values.add(v)
        cases.append(sorted(values))
    for values in cases:
        links = simhash.forest(np.array(values, np.uint64).view(np.int64), 4)
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
        assert brute_groups_of_links([(a % (1 << 64), b % (1 << 64)) for a, b in links], values) == brute_groups(values, 4)


def test_components_of_long_chains_and_stars(spark):
    from graphloom.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (None, 3)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated passages


def brute_removal(rows, k=20):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    seen, out = set(), []
    for r in order:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_removal_against_brute_force(docs, rows):
    want = sorted(map(str, brute_removal(rows)))
    for n, size in ((1, 8 << 20), (3, 2000)):
        got = substring.remove_repeats(docs, n_batches=n, chunk_bytes=size).collect()
        assert sorted(str((g.doc_id, g.n_words, g.n_removed, g.kept_sha256, g.kept_text)) for g in got) == want
        assert all(sum(s.end - s.begin for s in g.removed_spans) == g.n_removed for g in got)


def test_far_apart_words_with_weak_hashes_are_not_taken_for_equal():
    """Thue-Morse words and their complements, which polynomial hashes modulo 2**64 confuse."""
    word = b"a"
    while len(word) < 1024:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba")).decode()
    word = word.decode()
    tail = " ".join(f"w{i}" for i in range(19))
    data, offsets = K.flat(pa.array([f"{word}\n{other}\n{word}", f"{word} x y {other} x y"]))
    found = decision_list.count_texts(data, offsets)
    assert found["n_dup_lines"].tolist() == [1, 0] and found["n_repeat_words"].tolist() == [0, 0]
    w = substring.Windows(*K.flat(pa.array([f"{word} {tail}", f"{other} {tail}"])))
    assert len(set(w.digests(np.array([0, 20]))[0].tolist())) == 2


def test_verification_does_not_rest_on_the_hash(spark, monkeypatch):
    monkeypatch.setattr(K, "span_hashes", lambda d, s, e, which=0: np.full(len(s), 7, np.uint64))
    texts = ["one two three\nfour five six\none two three", "one two three four one two three"]
    data, offsets = K.flat(pa.array(texts))
    found = decision_list.count_texts(data, offsets)
    assert list(zip(found["n_dup_lines"].tolist(), found["n_repeat_words"].tolist(), strict=True)) == [brute_counts(t)[3:] for t in texts]
    ids = K.exact_ids(data, *K.words(data, offsets)[:2])
    words = [w for t in texts for w in WORD.findall(t)]
    assert len(set(ids.tolist())) == len(set(words)) == len(set(zip(ids.tolist(), words, strict=True)))


def test_a_later_batch_is_judged_against_history(spark, docs, rows):
    old = [r for r in rows if r[0] is None or r[0] % 2]
    new = [r for r in rows if r[0] is not None and not r[0] % 2]
    frame = lambda x: spark.createDataFrame(x, docs.schema).repartition(2)
    index = substring.FingerprintIndex(spark, 8, 5, fanout=2)
    substring.remove_repeats(frame(old), index=index, n_batches=2).count()
    got = substring.remove_repeats(frame(new), index=index, n_batches=2).collect()
    # History is earlier: give it ids before all others, in its own order.
    order = sorted(old, key=lambda r: (r[0] is None, r[0] or 0))
    want = brute_removal([(i - 10**6, r[1]) for i, r in enumerate(order)] + [(r[0], r[1]) for r in new])
    assert sorted(str((g.doc_id, g.n_removed, g.kept_text)) for g in got) == sorted(str((w[0], w[2], w[4])) for w in want if w[0] >= 0)


def test_cut_texts_keep_their_spacing_and_any_column_name_passes(spark, docs, rows):
    d = docs.selectExpr("doc_id", "text", "1 AS chunk", "2 AS _chunk", "3 AS id", "4 AS tie", "5 AS k0")
    out = substring.remove_repeats(d).collect()
    texts = {r[1] for r in rows}
    for r in out:
        assert (r.chunk, r._chunk, r.id, r.tie, r.k0) == (1, 2, 3, 4, 5)
        assert " ".join(WORD.findall(r.cut_text or "")) == r.kept_text
        assert r.n_removed or r.cut_text in texts


def test_work_for_a_chunk_follows_its_keys_not_the_buckets():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64) * 2)
    for buckets in (16, 10**6):
        parts = substring._by_bucket(keys, buckets)
        assert len(parts) <= len(keys) and sum(s.stop - s.start for _, s in parts) == len(keys)
        assert all(int(k) * buckets >> 64 == b for b, s in parts for k in keys[s]) and all(0 <= b < buckets for b, _ in parts)


def test_hot_passages_are_reported_by_each_task(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 1)
    monkeypatch.setattr(substring, "FLUSH", 40)
    monkeypatch.setattr(substring, "PART", 3)
    passage = " ".join(f"hot{i}" for i in range(30))
    data = [(i, f"{passage} own{i} " + " ".join(f"x{i}y{j}" for j in range(25))) for i in range(60)] + [(None, passage), (None, passage + " end")]
    out = substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4), chunk_bytes=300).collect()
    got = {r.doc_id: r.n_removed for r in out if r.doc_id is not None}
    assert got == {i: 30 if i else 0 for i in range(60)} and sorted(r.n_removed for r in out if r.doc_id is None) == [30, 30]


def test_index_reports_repeats_across_batches_and_survives_compaction(spark):
    text = " ".join(f"w{i}" for i in range(200))
    parts = [spark.createDataFrame([(i, t)], "doc_id long, text string") for i, t in enumerate([text, "other words " * 30, text])]
    index = substring.FingerprintIndex(spark, 4, 4)
    index.append(parts[0])
    assert index.repeats().count() == 0
    index.append(parts[1])
    index.compact()
    assert len(index.runs) == 1
    before = index.repeats().count()
    index.append(parts[2])
    assert index.repeats().count() > before


def test_empty_tables(no_docs, spark):
    assert substring.remove_repeats(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert decision_list.with_counts(no_docs).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.find_leaks(no_docs, bench).count() == 0


# --- winnowing

LEAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(t, items):
    w = LEAK.findall(low(t or ""))
    hit, found = [False] * len(w), set()
    for item, body in items:
        v = LEAK.findall(low(body or ""))
        n = min(8, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
                if item is not None:
                    found.add(str(item))
    return len(w), sum(hit), sorted(found)


def test_leaks_against_brute_force(docs, rows, spark):
    passage = LEAK.findall(low(rows[20][1]))
    items = [(1, rows[0][1]), (2, " ".join(passage[:12]).upper()), (10, "of the"), (11, "ONE"), (12, None), (13, "--- !!"), (None, " ".join(passage[3:15])), (2, "x1 the of"), (14, "no such words here at all in any of these texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str((r[0], *brute_leaks(r[1], items))) for r in rows)
    for size in (1 << 20, 60):
        got = winnowing.find_leaks(docs, bench, max_block_bytes=size).collect()
        assert sorted(str((g.doc_id, g.n_words, g.n_hit, g.item_ids)) for g in got) == want
        assert all(sum(s.end - s.begin for s in g.hit_spans) == g.n_hit for g in got)


def test_cut_takes_only_long_spans(spark):
    body = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(1, body), (2, "alpha")], "item_id long, text string")
    d = spark.createDataFrame([(1, f"Alpha start, {body.upper()}! end"), (2, "alpha only"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in winnowing.find_leaks(d, bench, cut=True).collect()}
    assert out == {1: "Alpha start, end", 2: "alpha only", 3: None}


def test_the_benchmark_index_is_small_and_one_at_a_time(spark):
    body = " ".join(f"word{i * 7919 % 10007}" for i in range(60_000))
    index = winnowing.BenchmarkIndex([("a", body), ("b", body[:2000])])
    assert index.nbytes() < 10 * len(body)
    assert index.windows[8].items(index.text, " ".join(body.split()[:8]).encode()).tolist() == [0, 1]
    assert index.windows[8].items(index.text, b"no such window") is None


def test_cut_of_short_items_if_asked_for(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "the")], "item_id long, text string")
    d = spark.createDataFrame([(1, "so Alpha, beta gamma! end of the day", 5)], "doc_id long, text string, n_hit int")
    r = winnowing.find_leaks(d, bench, cut=True, shortest_cut=3).first()
    assert r.text == "so end of the day" and r.n_hit == 4 and r.item_ids == ["1", "2"]


@given(st.lists(st.sampled_from("abcd"), min_size=8, max_size=40), st.lists(st.sampled_from("abcd"), max_size=10), st.lists(st.sampled_from("abcd"), max_size=10))
@settings(max_examples=80, deadline=None)
def test_every_shared_window_keeps_a_common_gram(shared, before, after):
    index = winnowing.BenchmarkIndex([("i", " ".join(shared))])
    text = " ".join([*before, *shared, *after])
    data, offsets = K.flat(pa.array([text]))
    first, hit, items = index.find(data, offsets)
    assert int(hit.sum()) == brute_leaks(text, [("i", " ".join(shared))])[1] and items[0] == {"i"}
