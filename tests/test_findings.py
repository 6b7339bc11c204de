"""What a review found on larger tables, by hand-made rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quiremill.functions.text import words
from quiremill.operators import compose, layer, order, pagewise, specs, verify
from quiremill.plans import catalog, inputs
from quiremill.plans.catalog import QUERIES
from quiremill.sources import tables


def test_line_numbers_of_a_million_and_more_stay_on_their_page(spark):
    rows = [(1, 1, 1_000_001, "Memory: 8 GB"), (1, 2, 1, "Processor: Xeon"), (2, 1, 3_000_002, "- 16 GB memory"), (2, 4, 2, "- 1 TB disk")]
    lines = spark.createDataFrame(rows, "doc_id long, page_number int, line_no int, text string")
    got = specs.key_values(lines).select("page_number", "line_no", "category").collect()
    assert {tuple(r) for r in got} == {(1, 1_000_001, "Memory"), (2, 1, "Processor")}
    cells = spark.createDataFrame([], "doc_id long, table_id long, row int, col int, text string")
    both = specs.components(cells, lines).where(F.col("doc_id") == 2)
    assert {r.description for r in both.collect()} == {"16 GB memory", "1 TB disk"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_and_rows_shuffle_packed_pages_once(spark, sf):
    words = tables.token_boxes(spark.read.parquet(f"{sf}/documents.parquet"))
    for df in (layer.text_runs(words), layer.text_runs(words, exact_rows=True), layer.visual_rows(words, "token_idx")):
        assert plan_of(df).count("Exchange hashpartitioning(doc_id") == 1
        assert "Window" not in plan_of(df)


def test_a_page_in_several_places_is_one_page(spark):
    box = "doc_id long, page_number int, token_idx int, text string, x1 double, y1 double, x2 double, y2 double"
    rows = [(d, 1, i, f"w{i}", 50.0 * i, 0.0, 50.0 * i + 40, 20.0) for i in range(6) for d in (1, None)]
    rows += [(1, 1, 6, None, 0.0, 40.0, 30.0, 60.0), (1, 1, 7, "far", 200.0, 41.0, 230.0, 61.0), (2, 1, 0, "flat", None, 5.0, 9.0, 5.0)]
    words = spark.createDataFrame(rows, box).repartition(7)
    want = {(1, 0, "w0 w1 w2 w3 w4 w5", 6), (None, 0, "w0 w1 w2 w3 w4 w5", 6), (1, 1, "", 1), (1, 2, "far", 1), (2, 0, "flat", 1)}
    assert {tuple(r) for r in layer.text_runs(words).select("doc_id", "line_idx", "text", "n_words").collect()} == want
    got = {tuple(r) for r in layer.visual_rows(words, "token_idx").select("doc_id", "row_id", "text", "n_items").collect()}
    whole = "  ".join(f"w{i}" for i in range(6))
    assert got == {(1, 1, whole, 6), (None, 1, whole, 6), (1, 2, "far", 2), (2, 1, "flat", 1)}


def test_recall_order_and_ranks_shuffle_packed_pages_once(spark, sf):
    words = tables.token_boxes(spark.read.parquet(f"{sf}/documents.parquet"))
    region = words.withColumn("region_idx", F.lit(1))
    for df in (verify.word_recall(words, words), verify.order_fidelity(words, words), verify.gold_ranks(region, words), verify.page_words(words, F.lit(True))):
        assert plan_of(df).count("Exchange hashpartitioning(doc_id") == 1
        assert "Aggregate" not in plan_of(df)


def test_recall_of_pages_without_truth_or_words(spark):
    kind = "doc_id long, page_number int, token_idx int, text string"
    truth = spark.createDataFrame([(1, 1, 0, "Alpha"), (1, 1, 1, "alpha!"), (1, 1, 2, None), (1, 1, 3, "ab"), (2, 1, 0, None)], kind)
    got = spark.createDataFrame([(1, 1, 0, "ALPHA"), (1, 1, 1, None), (3, 1, 0, "beta")], kind)
    assert {tuple(r) for r in verify.word_recall(truth, got).collect()} == {(1, 1, 2, 2, 100.0), (2, 1, 0, 0, None)}


def test_tables_shuffle_packed_once(spark):
    cell = "doc_id long, page_number int, region_idx int, row int, col int, x1 double, y1 double, x2 double, y2 double, text string"
    c = spark.createDataFrame([(1, 1, 0, r, k, 100.0 * k, 40.0 * r, 100.0 * k + 95, 40.0 * r + 38, f"{r}|{k}") for r in (0, 1, 3) for k in (0, 2)], cell).repartition(5)
    kind = "doc_id long, page_number int, region_idx int, line_idx int, text string, x1 double, y1 double, x2 double, y2 double"
    rows = [(1, 1, 0, 10 * k + b, f"l{k}{b}", 100.0 * k + 5, 42.0 + 18 * b, 100.0 * k + 60, 52.0 + 18 * b) for k in (0, 2) for b in (0, 1)]
    l = spark.createDataFrame([*rows, (2, 1, 0, 0, "no cells", 0.0, 0.0, 9.0, 9.0)], kind).repartition(5)
    assert "Window" not in plan_of(compose.split_markdown(c, l))
    for df in (compose.grid_markdown(c), compose.expand_rows(c, l), compose.split_markdown(c, l)):
        assert plan_of(df).count("Exchange hashpartitioning(doc_id") == 1
    want = "| 0\\|0 |  | 0\\|2 |\n|---|---|---|\n| l00 |  | l20 |\n| l01 |  | l21 |\n| 3\\|0 |  | 3\\|2 |"
    assert [r.markdown for r in compose.split_markdown(c, l).collect()] == [want]
    assert [r.markdown for r in compose.grid_markdown(compose.numbered_rows(compose.expand_rows(c, l))).collect()] == [want]


def test_inputs_by_key_are_cut_for_tasks_of_bounded_size(spark, sf, monkeypatch):
    monkeypatch.setitem(inputs.KEYS, "customer", ("c_custkey", 300))
    d = inputs.Data(spark, sf)
    many = spark.table(d.keyed("customer"))
    assert many.rdd.getNumPartitions() > 8 and many.count() == d.table("customer").count()


def test_packed_pages_come_back_bit_by_bit_and_small():
    rng = np.random.default_rng(3)
    page = np.sort(rng.integers(0, 9, 3000))
    none = rng.random(3000) < 0.1
    odd = rng.choice([0.0, -0.0, 1.5, np.nan, np.inf, -np.inf, 1e300, 3.0], 3000)
    text = pa.array([["", "a|b", "é", "\U0001f600 x"][i] for i in rng.integers(0, 4, 3000)])
    cols = {"big": pa.array(rng.integers(-(2**63), 2**63 - 1, 3000)), "odd": pa.array(odd), "some": pa.array(odd, mask=none, from_pandas=False), "flag": pa.array(none, mask=none), "text": text, "gone": pa.nulls(3000, pa.string())}
    cols["less"] = pa.array([None if n else t for n, t in zip(none.tolist(), text.to_pylist())])

    def blobs(cols):
        b = pa.RecordBatch.from_arrays([pa.array(page), *cols.values()], names=["page", *cols])
        return [x for g in pagewise._pack(["page"], list(cols), [], ["page", "size", "pack"])(iter([b.slice(7)])) for x in g["pack"].to_pylist()]

    counts, got = pagewise._decoded(blobs(cols), [c.type for c in cols.values()])
    assert counts.sum() == 3000 - 7
    for c, g in zip(cols.values(), got):
        g.validate(full=True)
        if pa.types.is_floating(c.type):
            assert g.is_valid().equals(c.slice(7).is_valid())
            c, g = (pa.array(np.asarray(x.fill_null(7.0)).view(np.int64)) for x in (c.slice(7), g))
            assert g.equals(c)
        else:
            assert g.equals(c.slice(7))
    place = pa.array(np.arange(3000) % 10 * 70.0)
    assert sum(map(len, blobs({"x1": place, "y1": place, "x2": place, "y2": place}))) < 3000


def test_whole_documents_move_neither_words_nor_lines_row_by_row(spark, sf):
    plan = plan_of(QUERIES["process_documents"](spark, sf))
    assert "LeftSemi" not in plan and "collect_list" not in plan


def test_what_is_cut_is_small_and_the_same(spark, sf, tmp_path, monkeypatch):
    want = sorted(map(tuple, QUERIES["process_documents"](spark, sf).collect()))
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: str(tmp_path))
    assert sorted(map(tuple, QUERIES["process_documents"](spark, sf).collect())) == want
    text = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 2 * text


def test_runs_tell_wanted_pages_and_placeholders(spark):
    box = "doc_id long, page_number int, token_idx int, text string, x1 double, y1 double, x2 double, y2 double"
    rows = [(1, 1, 0, "PLEASE", 0.0, 0.0, 40.0, 20.0), (1, 1, 1, "Wait", 0.0, 90.0, 40.0, 110.0), (1, 1, 2, "Adobe Reader", 0.0, 180.0, 40.0, 200.0)]
    rows += [(2, 1, 0, "please wait", 0.0, 0.0, 40.0, 20.0), (3, 1, 0, "please waİt adobe reader", 0.0, 0.0, 40.0, 20.0), (None, 1, 0, "x", 0.0, 0.0, 4.0, 20.0)]
    tokens = spark.createDataFrame(rows, box)
    wanted = spark.createDataFrame([(2, 1), (9, 1)], "doc_id long, page_number int")
    got = layer.text_runs(tokens, wanted=wanted)
    assert plan_of(got).count("Exchange hashpartitioning(doc_id") == 1
    assert {tuple(r) for r in got.select("doc_id", "wanted", "is_placeholder").collect()} == {(1, False, True), (2, True, False), (3, False, False), (None, False, False)}
    plain = layer.xfa_placeholder(layer.text_runs(tokens)).where("is_placeholder").collect()
    assert [r.doc_id for r in plain] == [1]


def test_finished_pages_say_what_the_single_operators_say(spark, sf):
    d = inputs.Data(spark, sf)
    lines = catalog._page_lines(d).withColumn("confidence", (F.col("line_idx") % 7) / 7.0)
    lines = lines.withColumn("text", F.when(F.col("line_idx") % 9 == 4, None).when(F.col("line_idx") % 5 == 1, F.concat("text", F.lit(" ΣΣ, Straße -- x"))).otherwise(F.col("text")))
    ordered = order.reading_order(d.regions().where("region_idx % 6 <> 2 or type = 'PageFurniture'"))
    claimed = compose.claim(lines, ordered).withColumn("is_furniture", F.coalesce(F.col("region_type") == "PageFurniture", F.lit(False)) | (F.col("line_idx") % 10 == 3))
    claimed = claimed.unionByName(claimed.where("is_furniture and line_idx < 40").withColumn("is_furniture", F.lit(False)).withColumn("region_idx", F.lit(10_000)).withColumn("text", F.concat(F.lit("gone "), "text")))
    claimed = claimed.unionByName(claimed.where("text like 'gone%' and line_idx < 20").withColumn("is_furniture", F.lit(True))).localCheckpoint()
    blocks = compose.region_markdown(claimed, ordered)
    truth = lines.select("doc_id", "page_number", F.explode(F.split(F.concat("text", F.lit(" missing")), " ")).alias("text"))
    got = compose.finished_pages(claimed, blocks, truth, 0.5).localCheckpoint()
    key = ["doc_id", "page_number"]
    lost = verify.lost_lines(claimed, got.select(*key, "markdown"))
    assert {tuple(r) for r in got.select(*key, "lines_lost").collect()} == {tuple(r) for r in lost.collect()} and got.agg(F.sum("lines_lost")).first()[0] > 0
    assert {tuple(r) for r in got.select(*key, "words").collect()} == {tuple(r) for r in layer.confident_words(claimed, 0.5).collect()}
    shown = got.select(*key, F.explode(words(F.col("markdown"))).alias("text")).unionByName(claimed.where("is_furniture").select(*key, F.explode(words(F.col("text"))).alias("text")))
    recall = {tuple(r) for r in verify.word_recall(truth, shown).select(*key, "truth_words", "truth_found").collect()}
    assert {tuple(r) for r in got.select(*key, "truth_words", "truth_found").collect()} == recall
    assert any(t > f > 0 for _, _, t, f in recall)


def test_orphans_go_before_the_first_block_below_them():
    rng = np.random.default_rng(5)
    for _ in range(300):
        ys = rng.choice([0.0, 1.0, 2.0, 3.0, 4.0, np.nan], rng.integers(0, 9)).tolist()
        rows = rng.choice([0.5, 1.0, 2.5, 4.0, 9.0, np.nan], rng.integers(0, 9)).tolist()
        want = list(enumerate(ys))
        for i, y in enumerate(rows, len(ys)):
            want.insert(next((k for k, b in enumerate(want) if b[1] > y), len(want)), (i, y))
        assert compose._placed(ys, rows) == [i for i, _ in want]


def test_cells_and_lines_are_joined_once_and_equal_cells_stay_apart(spark, sf):
    plan = plan_of(QUERIES["table_cells"](spark, sf))
    assert sum(plan.count(f"- {kind}") for kind in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) == 1
    assert plan.count("Exchange hashpartitioning") == 2
    cell = "doc_id long, page_number int, region_idx int, row int, col int, x1 double, y1 double, x2 double, y2 double, own string"
    rows = [(1, 1, 0, 0, 0, 0.0, 0.0, 9.0, 9.0, "a"), (1, 1, 0, 0, 0, 0.0, 0.0, 9.0, 9.0, "a"), (1, 1, 0, 0, 1, 5.0, 0.0, 20.0, 9.0, "b"), (1, 1, 0, 1, None, 0.0, 0.0, 9.0, 9.0, "c"), (None, 1, 0, 0, 0, 0.0, 0.0, 9.0, 9.0, "d"), (2, 1, 0, 0, 0, 0.0, None, 9.0, 9.0, None)]
    kind = "doc_id long, page_number int, region_idx int, line_idx int, text string, x1 double, y1 double, x2 double, y2 double"
    lines = [(1, 1, 0, 1, "v", 4.0, 2.0, 6.0, 4.0), (1, 1, 0, 0, None, 1.0, 1.0, 2.0, 2.0), (1, 1, 0, None, "u", 4.0, 2.0, 6.0, 4.0), (None, 1, 0, 0, "n", 1.0, 1.0, 2.0, 2.0), (2, 1, 0, 0, "y", 1.0, 1.0, 2.0, 2.0), (1, 2, 0, 0, "p", 1.0, 1.0, 2.0, 2.0)]
    got = compose.fill_cells(spark.createDataFrame(rows, cell), spark.createDataFrame(lines, kind)).select("doc_id", "col", "own", "text", "n_lines").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, "a", "u v", 3), (1, 0, "a", "u v", 3), (1, 1, "b", "u v", 2), (1, None, "c", "", 0), (None, 0, "d", "", 0), (2, 0, None, "", 0)]))
