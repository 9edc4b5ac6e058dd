"""The registered queries of the engine's operators, over the views of a warehouse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexers
from ..functions import scalars as S
from ..functions.lexers import import_specs, text_identifiers
from ..operators import changes, fields, graphs, modules, proposals, puzzles, sweeps, symbols
from ..operators.readings import config, evidence, ranked, readings
from ..sources import inputs
from ..sources import views as V
from ..sources.json_array import split_rows
from ..streaming import demand_stream
from .staging import shared_dir, staged

FIELDS = ("correction", "capacity", "utilization", "score", "collapse_potential", "confidence")


def signal_kind_join(spark: SparkSession, sf: str) -> DataFrame:
    e = fields.weighted(V.corrections(spark, sf))
    return e.groupBy("kind").agg(F.count("*").alias("n"), fields.total(F.col("w")).alias("weight"), F.count_if("arrow").alias("n_arrows"))


def demand_agg(spark: SparkSession, sf: str) -> DataFrame:
    return fields.demand(V.corrections(spark, sf)).select("capability", "count", "demand", S.rounded(F.col("arrow_share"), 6).alias("arrow_share"))


def coherence(spark: SparkSession, sf: str) -> DataFrame:
    return fields.demand(V.corrections(spark, sf)).select("capability", S.rounded(F.col("coherence"), 6).alias("coherence"), "direction_known")


def usage_known(spark: SparkSession, sf: str) -> DataFrame:
    return V.capabilities(spark, sf).select(F.col("id").alias("capability")).join(fields.usage(V.usage(spark, sf)), "capability", "left").select("capability", "usage_total", F.coalesce("known", F.lit(False)).alias("known"))


def correction_field(spark: SparkSession, sf: str) -> DataFrame:
    d = fields.demand(V.corrections(spark, sf))
    return d.select("capability", S.rounded(S.clamp01(S.saturate(F.col("demand"), V.C_HALF) * (F.lit(0.5) + F.lit(0.5) * F.col("coherence")))).alias("correction"))


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("c_acctbal")
    return V.table(spark, sf, "customer").select(
        "c_custkey",
        S.clamp01(b / 5000).alias("clamped"),
        S.rounded(b / 7, 3).alias("rounded"),
        S.rounded(S.saturate(b, 1000.0), 6).alias("saturated"),
        S.rounded(F.element_at(S.geom_space(0.5, 2.0, 5), F.col("c_nationkey") % 5 + 1), 6).alias("geometric"),
        S.rounded(F.element_at(S.lin_space(0.2, 0.8, 5), F.col("c_nationkey") % 5 + 1), 6).alias("linear"),
    )


def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("_"), F.col("p_type"), F.lit("s"), F.col("p_brand"))
    return V.table(spark, sf, "part").select("p_partkey", F.array_join(S.split_identifier(name), "|").alias("words"), F.array_join(S.identifier_parts(name), "|").alias("parts"))


def text_lexer(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_sort(text_identifiers(F.col("html")))
    return V.table(spark, sf, "pages").select("page_id", F.size(ids).cast("long").alias("n_identifiers"), F.md5(F.array_join(ids, ",").cast("binary")).alias("digest"))


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_sort(S.words_of(F.col("after")))
    return V.turns(spark, sf, "user").select("conv_id", "turn", F.size(words).cast("long").alias("n_words"), F.array_join(words, ",").alias("words"))


def signal_match(spark: SparkSession, sf: str) -> DataFrame:
    return fields.capacity(V.capabilities(spark, sf), V.tokens(spark, sf)).select("capability", "n_matched", "n_files", "hits")


def capacity_field(spark: SparkSession, sf: str) -> DataFrame:
    c = V.capabilities(spark, sf).select(F.col("id").alias("capability"), F.size("signals").alias("declared"))
    k = fields.capacity(V.capabilities(spark, sf), V.tokens(spark, sf))
    joined = c.join(k, "capability", "left").fillna(0, ["n_matched", "n_files"])
    share = S.capacity_confidence(F.col("n_matched"), F.col("declared"))
    return joined.select("capability", S.rounded(S.clamp01(share * S.saturate(F.col("n_files").cast("double"), V.K_HALF))).alias("capacity"), S.rounded(share).alias("capacity_confidence"))


def view_evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = V.capabilities(spark, sf)
    return evidence(c, fields.demand(V.corrections(spark, sf)), fields.capacity(c, V.tokens(spark, sf)), fields.usage(V.usage(spark, sf)))


def view_readings(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(readings(view_evidence(spark, sf), V.scales(spark)))


def readings_query(spark: SparkSession, sf: str) -> DataFrame:
    return view_readings(spark, sf).select("capability", *FIELDS, "known", "category", "rank")


def part_readings(spark: SparkSession, sf: str) -> DataFrame:
    """As many keys as there are parts: demand by a line's quantity and what became of it, capacity by suppliers, use by discounts."""
    lines = V.table(spark, sf, "lineitem").withColumn("capability", F.col("l_partkey").cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "correction").when(F.col("l_returnflag") == "A", "repetition").otherwise("retry")
    events = lines.select("capability", kind.alias("kind"), (F.col("l_quantity") / 10).alias("weight"), F.lit("part").alias("after"), F.array("l_linestatus").alias("direction"))
    capacity = lines.groupBy("capability").agg(F.count_distinct("l_suppkey").alias("n_files"), F.count_distinct("l_returnflag").alias("n_matched"))
    used = lines.select("capability", F.floor(F.col("l_discount") * 100 + 0.5).alias("count"))
    parts = V.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"), F.array(*(F.lit(x) for x in "ANR")).alias("signals"))
    scores = readings(evidence(parts, fields.demand(events), capacity, fields.usage(used)), config(spark, 60.0, 10.0, 200.0, 0.5))
    return ranked(scores).select("capability", "score", "collapse_potential", "category", "rank")


def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return view_readings(spark, sf).orderBy("rank").limit(10).select("rank", "capability", "score", "category", S.bar(F.col("score")).alias("bar"), S.percent(F.col("confidence")).alias("confidence"))


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return view_readings(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.count_if(S.is_candidate(F.col("category"))).alias("n_candidates"))


def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    co = proposals.cooccurrence(proposals.event_words(V.turns(spark, sf, "user")))
    return co.groupBy("token").agg(F.count("*").alias("n_others"), F.sum("n").alias("n_pairs"), F.max("n").alias("most"))


def token_expand(spark: SparkSession, sf: str) -> DataFrame:
    words = staged(proposals.event_words(V.turns(spark, sf, "user")), "words")
    return words.groupBy("ord").agg(F.count("*").alias("n_words")).join(proposals.expanded_sizes(words, 3), "ord")


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = proposals.overlap_pairs(proposals.event_words(V.turns(spark, sf, "user")), proposals.THRESHOLD)
    return found.groupBy("a").agg(F.count("*").alias("n_linked"), S.rounded(F.max("overlap"), 6).alias("most"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    return proposals.clusters(staged(proposals.event_words(V.turns(spark, sf, "user")), "words"))


def cluster_signals(spark: SparkSession, sf: str) -> DataFrame:
    words = staged(proposals.event_words(V.turns(spark, sf, "user")), "words")
    of = proposals.clusters(words)
    return proposals.signals(proposals.support(words, of))


def discover(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = proposals.propose(V.turns(spark, sf, "user"))
    return found.select(F.col("ord").alias("root"), "id", "label", F.array_join("signals", ",").alias("signals"), "n_members")


def discover_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The same without the words that stand beside an event's own, so with a higher threshold."""
    found, _ = proposals.propose(V.turns(spark, sf, "user"), threshold=0.6, least=0)
    return found.select(F.col("ord").alias("root"), "id", "label", F.array_join("signals", ",").alias("signals"), "n_members")


def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    asked = V.turns(spark, sf, "user").select("conv_id", "turn", S.words_of(F.col("after")).alias("a"))
    said = V.turns(spark, sf, "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), S.words_of(F.col("after")).alias("b"))
    both = asked.join(said, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.size(F.array_intersect("a", "b")).cast("long").alias("n_common"), F.size(F.array_union("a", "b")).cast("long").alias("n_all"), S.rounded(S.overlap_coefficient(F.col("a"), F.col("b")), 6).alias("overlap"))


def bfs_hops(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.hops(V.supplier_links(spark, sf), V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source")))


def view_distances(spark: SparkSession, sf: str) -> DataFrame:
    members = V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("node"))
    return graphs.mean_distances(members, V.supplier_links(spark, sf))


def mean_distance(spark: SparkSession, sf: str) -> DataFrame:
    return view_distances(spark, sf).select("owner", S.rounded(F.col("distance"), 6).alias("distance"), "n_nodes")


def integration_label(spark: SparkSession, sf: str) -> DataFrame:
    return view_distances(spark, sf).select("owner", S.integration_label(F.col("distance")).alias("integration"))


def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.degrees(V.supplier_links(spark, sf).where("src < dst"))


def sweep_l2(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged(view_evidence(spark, sf), "sweep-evidence")
    return sweeps.level2(rows).select(
        "capability", "baseline_cp", "baseline_rank", "baseline_category", "configurations", *(S.rounded(F.col(c), 6).alias(c) for c in ("rank1_share", "candidate_share", "cp_min", "cp_max")), "knob", "low_level", "high_level",
        S.stability_verdict(F.col("baseline_cp"), F.col("candidate_share"), F.col("rank1_share")).alias("verdict"),
    )


def sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged(view_evidence(spark, sf), "sweep-evidence")
    return sweeps.knob_levels(sweeps.second_level(rows))


def sweep_l3(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged(view_evidence(spark, sf), "sweep-evidence")
    return sweeps.level3(rows).select("capability", "baseline_cp", *(S.rounded(F.col(c), 6).alias(c) for c in ("l2_share", "min_share", "max_share", "mean_share", "spread", "rank1_min")), "class_converges")


def compare_verdict(spark: SparkSession, sf: str) -> DataFrame:
    c, k, u = V.capabilities(spark, sf), staged(fields.capacity(V.capabilities(spark, sf), V.tokens(spark, sf)), "capacity"), fields.usage(V.usage(spark, sf))
    e = V.corrections(spark, sf)
    sides = [readings(evidence(c, fields.demand(V.half(e, later)), k, u), V.scales(spark)) for later in (False, True)]
    return changes.compared(*sides).select("capability", *(S.rounded(F.col(x), 6).alias(x) for x in ("d_collapse_potential", "d_correction", "d_utilization")), "verdict")


def module_filters(spark: SparkSession, sf: str) -> DataFrame:
    d = graphs.degrees(V.supplier_links(spark, sf).where("src < dst")).withColumnRenamed("node", "s")
    parts = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.countDistinct("l_partkey").alias("n_defs"))
    all_ = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s")).join(d, "s", "left").join(parts, "s", "left").fillna(0, ["n_defs", "in_degree", "out_degree"])
    return modules.roles(all_).select("s", *(f"is_{x}" for x in ("foundation", "surface", "rich", "isolated")))


def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws("\n", F.concat(F.lit("from "), F.repeat(F.lit("."), F.col("p_size") % 4), F.lit("m"), F.col("p_size").cast("string"), F.lit(" import x")), F.concat(F.lit("  import lib.n"), (F.col("p_partkey") % 7).cast("string")), F.lit("# import nothing"), F.col("p_name"))
    importer = F.concat(F.lit("a.b.c.p"), F.col("p_partkey").cast("string"))
    rows = V.table(spark, sf, "part").select("p_partkey", importer.alias("importer"), F.explode(import_specs(text)).alias("spec"))
    return rows.select("p_partkey", "spec", S.absolute_module(F.col("spec"), F.col("importer")).alias("module"), S.parent_module(S.absolute_module(F.col("spec"), F.col("importer"))).alias("parent"))


def test_files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("concat(CASE p_partkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/test/' WHEN 2 THEN 'contest/' ELSE '' END, CASE p_size % 4 WHEN 0 THEN 'test_a' WHEN 1 THEN 'a_test' WHEN 2 THEN 'conftest' ELSE 'main' END, '.py')")
    return V.table(spark, sf, "part").select("p_partkey", modules.is_test(path).alias("is_test"), S.module_name(path).alias("module"), S.plain_path(F.concat(F.lit("A/./b/../"), path)).alias("plain"))


def stencil(spark: SparkSession, sf: str) -> DataFrame:
    filled = V.table(spark, sf, "part").select((F.col("p_partkey") % 1600).cast("int").alias("cell"), "p_size").groupBy("cell").agg((F.max("p_size") > 40).cast("int").alias("value"))
    return puzzles.clues(filled, puzzles.square_board(spark, 40))


def puzzle_solution(spark: SparkSession, sf: str) -> DataFrame:
    near = staged(puzzles.square_board(spark, 20), "board")
    filled = V.table(spark, sf, "part").select((F.col("p_partkey") % 400).cast("int").alias("cell"), "p_size").groupBy("cell").agg((F.max("p_size") > 40).cast("int").alias("value"))
    return puzzles.solved(puzzles.clues(filled, near), near)


def wave(spark: SparkSession, sf: str) -> DataFrame:
    start = V.table(spark, sf, "nation").select((F.col("n_nationkey") * 61 % 1600).cast("int").alias("cell"))
    return puzzles.wave(start, staged(puzzles.square_board(spark, 40), "board"), most=6)


def cube_surface(spark: SparkSession, sf: str) -> DataFrame:
    """The side is the number of regions, so that the board comes from a table as all others do."""
    side = V.table(spark, sf, "region").count()
    return puzzles.cube_surface(spark, side).groupBy("cell").agg(F.count("*").alias("n_near"), F.sum("near").alias("sum_near"))


def stream_demand(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = V.table_stream(spark, sf, "events")
    demand_stream.start(V.as_corrections(events), f"{at}/sums", f"{at}/checkpoint").awaitTermination()
    return demand_stream.demand_so_far(spark, f"{at}/sums").select("capability", "count", "demand", S.rounded(F.col("arrow_share"), 6).alias("arrow_share"), S.rounded(F.col("coherence"), 6).alias("coherence"), "direction_known")


def json_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Capabilities written as one JSON array and read again with their order."""
    at = f"{shared_dir(spark)}/inputs-{uuid.uuid4().hex}/capabilities.json"
    caps = V.capabilities(spark, sf).select(F.struct("ord", "id", "label", "signals").alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["id"].alias("id"), r["label"].alias("label"), r["signals"].alias("signals")))
    caps.agg(F.to_json(ordered).alias("value")).coalesce(1).write.text(at)
    return inputs.json_rows(spark, at, inputs.CAPABILITIES).select("ord", "id", "label", F.array_join("signals", ",").alias("signals"))


def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as JSON arrays, a file for each remainder of their numbers, and read again in parts."""
    at = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    docs = V.table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("part"), "doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("label"), F.col("text").alias("description"))).alias("value"))
    ends = docs.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # four rows, told to the planner: a join that is turned into a broadcast while it runs would undo the dealing by part below
    lines = docs.join(F.broadcast(ends), "part").select("part", "doc_id", F.concat(F.when(F.col("doc_id") == F.col("low"), F.lit("[")).otherwise(F.lit(",")), "value", F.when(F.col("doc_id") == F.col("high"), F.lit("]")).otherwise(F.lit(""))).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(at)
    rows, other = split_rows(spark, at, inputs.CAPABILITIES)
    if other:
        raise ValueError(f"no arrays: {', '.join(other)}")
    return rows.select(F.col("id").cast("long").alias("doc_id"), "ord", "label", F.md5(F.col("description").cast("binary")).alias("digest"))


def baseline_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Readings saved as a baseline and compared with themselves."""
    at = f"{shared_dir(spark)}/baseline-{uuid.uuid4().hex}"
    now = staged(view_readings(spark, sf), "readings")
    inputs.write_baseline(now, at)
    return changes.compared(inputs.read_baseline(spark, at), now)


def script_files(spark: SparkSession, sf: str) -> DataFrame:
    """A script for each part: it imports another part's, and its function calls that one's."""
    other = (F.col("p_partkey") * 7 + 3) % 100
    text = F.format_string("// part %1$d\nimport { makePart%2$d } from './part%2$d.js';\nexport function makePart%1$d(size: number) {\n  const name = `${size} of %3$s`;\n  return makePart%2$d(name.length);\n}\n", "p_partkey", other, "p_type")
    return V.parts(spark, sf).select(F.format_string("src/part%d.ts", "p_partkey").alias("path"), F.lit(".ts").alias("ext"), text.alias("text"))


def script_lexer(spark: SparkSession, sf: str) -> DataFrame:
    found = lexers.lexed(script_files(spark, sf))
    return found.select("path", F.array_join(F.array_sort("identifiers"), ",").alias("identifiers"), F.array_join(F.array_sort(F.transform("declarations", lambda d: d["name"])), ",").alias("declared"), F.array_join(F.transform("imports", lambda i: i["spec"]), ",").alias("imported"))


def import_graph(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.import_graph(lexers.lexed(script_files(spark, sf)))


def symbol_graph(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.symbol_graph(lexers.lexed(script_files(spark, sf)))


def module_map(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that import one of ten others, and define as many functions as their size in tens."""
    defs = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.col("p_size") / 10).cast("int")), lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit("(): pass"))), "\n")
    head = F.format_string("from .m%d import x\nimport pkg.m%d\n", F.col("p_partkey") % 10, F.col("p_partkey") % 3)
    files = V.parts(spark, sf).select(F.format_string("pkg/m%d.py", "p_partkey").alias("path"), F.lit(".py").alias("ext"), F.concat(head, defs).alias("text"))
    return modules.roles(modules.module_map(lexers.lexed(files))).select("module", "n_defs", "in_degree", "out_degree", "is_foundation", "is_surface", "is_rich", "is_isolated")


QUERIES = {
    "readings": readings_query,
    **{
        f.__name__: f
        for f in (
            signal_kind_join, demand_agg, coherence, usage_known, correction_field, scalar_functions, identifier_split, text_lexer, tokenize,
            signal_match, capacity_field, part_readings, top_k, category_counts, cooccurrence, token_expand, overlap_pairs, components, cluster_signals, discover, discover_plain,
            set_overlap, bfs_hops, mean_distance, integration_label, degree, sweep_l2, sensitivity, sweep_l3, compare_verdict, module_filters,
            python_imports, test_files, stencil, puzzle_solution, wave, cube_surface, stream_demand,
            json_inputs, json_arrays, baseline_round_trip, script_lexer, import_graph, symbol_graph, module_map,
        )
    },
}
