"""The stages in a row, each against brute force on its own input."""

import __spark_entry__ as entry
import corpus_pipeline as P
import public_tokenizers
import tiktoken

from graphloom.llm import bpe
from tests.llm.test_text_operators import WORD, brute_counts, brute_groups, brute_leaks, brute_print, brute_removal


def test_every_stage_against_its_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = docs.collect()
    for name, stage in P.STAGES:
        out = stage(spark, spark.createDataFrame(rows, docs.schema), small)
        new = out.collect()
        kept = {r.doc_id for r in new}
        if name == "quality_rules":
            failed = {r.doc_id for r in rows if (c := brute_counts(r.text))[0] < 50 or 100 * c[4] > 50 * c[0]}
            assert not kept & failed and len(kept) > 0.5 * (len(rows) - len(failed))
            bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()} - failed
            assert not (bad & {r.doc_id for r in rows}) - kept  # clean documents stay
        elif name == "near_duplicates":
            prints = {r.doc_id: brute_print(r.text) for r in rows}
            group = brute_groups(prints.values(), 4)
            low = {}
            for d, p in prints.items():
                low[group[p]] = min(low.get(group[p], d), d)
            assert kept == set(low.values())
        elif name == "repeated_passages":
            want = {d: t for d, n, gone, _, t in brute_removal([(r.doc_id, r.text) for r in rows]) if gone < n or n == 0}
            given = {r.doc_id: r for r in rows}
            assert {r.doc_id: " ".join(WORD.findall(r.text)) for r in new} == want
            same = [r for r in new if " ".join(WORD.findall(given[r.doc_id].text)) == want[r.doc_id]]
            assert all(r == given[r.doc_id] for r in same) and all(r.n_chars == len(r.text) for r in new if r not in same)
            assert any("\n" in r.text for r in new)  # line breaks stay
        elif name == "benchmark_leaks":
            found = {r.doc_id: brute_leaks(r.text, bench) for r in rows}
            assert kept == {d for d, f in found.items() if len(f[2]) < 2}
            assert all(r.text == next(x.text for x in rows if x.doc_id == r.doc_id) for r in new if not found[r.doc_id][1])
            assert all(not any(len(v.split()) >= 8 and brute_leaks(r.text, [(i, v)])[1] >= 8 for i, v in bench) for r in new if found[r.doc_id][1])
        else:
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            text = {r.doc_id: r.text for r in rows}
            assert all(r.token_ids == own.encode_ordinary(text[r.doc_id]) for r in new) and len(new) == len(rows)
            break
        assert out.columns == P.COLUMNS
        rows = new


def test_whole_short_items_are_cut_as_well(spark, tmp_path):
    bench = spark.createDataFrame([(1, "what is the tallest tower"), (2, "the of")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "Asked what is the Tallest tower? nobody knew of it"
    docs = spark.createDataFrame([(1, text, "en", "s", 99), (2, "all of the rest", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in P.benchmark_leaks(spark, docs, str(tmp_path)).collect()}
    assert out == {1: ("Asked nobody knew of it", 23), 2: ("all of the rest", 7)}


def test_run_and_registration(spark, small):
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {q if q == "pipeline" else q.split("_")[0] + "_" for q in entry.queries()}
    assert P.run(spark, small).count() > 0


def test_odd_rows_pass_the_stages(spark, docs, small):
    cols = docs.select(P.COLUMNS)
    for name, stage in P.STAGES:
        assert stage(spark, cols, small).count() > 0, name
        assert stage(spark, cols.limit(0), small).count() == 0, name


def test_repeated_and_null_ids_lose_no_group_and_leave_no_copy(spark, small):
    a, b, c, d = (" ".join(f"{x}{i * i % 97}" for i in range(80)) for x in ("ant", "bee", "cow", "dog"))
    data = [(5, a), (5, b), (7, a), (9, b), (None, a), (None, c), (None, c), (11, d), (11, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_duplicates(spark, docs, small).collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(map(str, [(5, a), (5, b), (None, c), (11, d)]))
