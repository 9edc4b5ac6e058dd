"""Registered queries of what works on files: the tree source, lexers, graphs, whole pipelines, reports and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexers
from ..functions import scalars as S
from ..operators import changes, fields, modules, presentation, sweeps, symbols
from ..operators.readings import evidence, readings
from ..sources import inputs
from ..sources import views as V
from ..sources.code_tree import code_files
from . import pipelines, samples
from .queries import FIELDS, view_evidence, view_readings
from .staging import staged


def joined(x: Column) -> Column:
    return F.array_join(F.array_sort(x), ",")


def sample_tree(spark: SparkSession, sf: str) -> str:
    return samples.write_tree(samples.tree(V.parts(spark, sf)))


def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3-7: what the source finds in a tree with folders that it must not walk and names that other readers hide."""
    return code_files(spark, sample_tree(spark, sf)).select("path", "ext", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def tree_lexers(spark: SparkSession, sf: str) -> DataFrame:
    """LEX2-8, LEX10, JN21, SRC9: names, definitions and imports in thirteen kinds of files, some of them broken."""
    found = lexers.lexed(samples.tree(V.parts(spark, sf)))
    imports = F.transform("imports", lambda i: F.concat_ws(":", i["dots"], i["spec"]))
    return found.select("path", joined(F.col("identifiers")).alias("identifiers"), joined(F.col("definitions")).alias("definitions"), joined(imports).alias("imports"))


def import_forms(spark: SparkSession, sf: str) -> DataFrame:
    """GRA1, JN12, JN13, WIN8, FLT11, LEX6, LEX7: each form that a relative import may take, and those that lead nowhere."""
    k = F.col("p_partkey")
    form = k % 19
    ext, how = samples.by_key(symbols.RESOLVED, F.greatest(F.lit(0), F.floor((form - 1) / 3))), (form + 2) % 3  # with another extension, with one more, as a folder
    target = F.when(form == 0, F.format_string("t%d.js", k)).when(how == 2, F.concat(F.format_string("t%d/index", k), ext)).otherwise(F.concat(F.format_string("t%d", k), ext))
    spec = F.when((form == 0) | (how == 0), F.format_string("./t%d.js", k)).otherwise(F.format_string("./t%d", k))
    script = F.concat(F.lit("import a from 'react';\nimport b from '"), spec, F.lit("';\nimport c from './none.js';\n"))
    python = F.format_string("import os\nfrom .q%d import z\nfrom . import w%d, none\nfrom ..up import t%d\n", k, k, k)
    texts = (
        (F.format_string("src/p%d.ts", k), F.lit(".ts"), script),
        (F.concat(F.lit("src/"), target), F.when(form == 0, F.lit(".js")).otherwise(ext), F.lit("")),
        (F.format_string("py/in/p%d.py", k), F.lit(".py"), python),
        (F.when(k % 2 == 0, F.format_string("py/in/q%d.py", k)).otherwise(F.format_string("py/in/q%d/__init__.py", k)), F.lit(".py"), F.lit("")),
        (F.format_string("py/in/w%d.py", k), F.lit(".py"), F.lit("")),
        (F.format_string("rb/r%d.rb", k), F.lit(".rb"), F.format_string("import './s%d'\nrequire 'json'\n", k)),
        (F.format_string("rb/s%d.ts", k), F.lit(".ts"), F.lit("")),
    )
    rows = F.array(*(F.struct(path.alias("path"), ext.alias("ext"), text.alias("text")) for path, ext, text in texts))
    files = V.parts(spark, sf).select(F.explode(rows).alias("r")).select("r.path", "r.ext", "r.text")
    return symbols.import_graph(lexers.lexed(files.unionByName(spark.createDataFrame([("py/up.py", ".py", "")], "path string, ext string, text string"))))


def sample_inputs(spark: SparkSession, sf: str) -> str:
    """Nations as capabilities, customers as events, suppliers as use: a folder of the three JSON files."""
    folder = samples.new_folder(spark)
    nation = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.lower("n_name").alias("capability"), "n_name")
    n = F.col("n").cast("long")
    view = F.format_string("View%d", 13 * n + 1)
    signals = F.when(n % 2 == 0, F.array(F.format_string("makeT%d", 13 * n), view, F.format_string("Box%d", 13 * n + 3), F.format_string("missing%d", n))).otherwise(F.array(F.format_string("Do%d", 13 * n + 7), F.format_string("run%d", 13 * n + 6), view))
    samples.write_json(nation.select(n.alias("ord"), F.col("capability").alias("id"), F.col("n_name").alias("label"), signals.alias("signals")), "capabilities", folder)
    kind = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'request' WHEN 'AUTOMOBILE' THEN 'correction' WHEN 'MACHINERY' THEN 'retry' WHEN 'HOUSEHOLD' THEN 'workaround' ELSE 'no such kind' END")
    events = V.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n")).select(
        F.col("c_custkey").alias("ord"), F.format_string("c%d", "c_custkey").alias("id"), "capability", kind.alias("kind"), F.lit("before").alias("before"), F.when(F.col("c_acctbal") < 0, "").otherwise("after").alias("after"),
        F.when(F.col("c_acctbal") > 9000, 2.5).alias("weight"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("direction"),
    )
    samples.write_json(events, "corrections", folder)
    samples.write_json(V.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n")).select(F.col("s_suppkey").alias("ord"), "capability", (F.col("s_acctbal") / 100).alias("count")), "usage", folder)
    return folder


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.scan(spark, sample_tree(spark, sf), sample_inputs(spark, sf))


def scan(spark: SparkSession, sf: str) -> DataFrame:
    """PIP1, SRC2, JN6, AGG18, GRA4-6, SRT6, PRJ3, SCL23."""
    e = F.col("evidence")
    return scanned(spark, sf).select(
        "capability", *FIELDS, "known", "category", "rank", "interpretation", "integration", S.rounded(F.col("integration_distance"), 4).alias("integration_distance"),
        F.array_join(e.capacity_files, ",").alias("files"), F.array_join(e.matched_signals, ",").alias("matched"), e.correction_count.alias("n_events"), e.demand.alias("demand"), e.direction_coherence.alias("coherence"), e.direction_known.alias("direction_known"),
    )


def quadrant(spark: SparkSession, sf: str) -> DataFrame:
    """FLT15, PIP10."""
    return presentation.quadrant(scanned(spark, sf)).select("capability", "label", S.rounded(F.col("x"), 4).alias("x"), "y", "side")


def badges(spark: SparkSession, sf: str) -> DataFrame:
    """PIP10, SCL23."""
    return presentation.badges(scanned(spark, sf))


def symbol_distances(spark: SparkSession, sf: str) -> DataFrame:
    """JN6, AGG18, GRA4."""
    found = pipelines.lexed_tree(spark, sample_tree(spark, sf))
    return symbols.symbol_distance(inputs.capabilities(spark, sample_inputs(spark, sf)), found).select("owner", S.rounded(F.col("distance"), 4).alias("distance"))


def file_distances(spark: SparkSession, sf: str) -> DataFrame:
    """GRA5 over import edges, files of a nation's keys being a capability's."""
    found = pipelines.lexed_tree(spark, sample_tree(spark, sf))
    members = found.select(F.floor(F.regexp_extract("path", r"f(\d+)\.", 1).cast("int") / 13).cast("int").alias("owner"), F.col("path").alias("node")).where(F.col("owner") < 25)
    return symbols.file_distance(members, symbols.import_graph(found)).select("owner", S.rounded(F.col("distance"), 4).alias("distance"))


#: What customers ask for, by key: three subjects, one of them in two wordings, and nothing.
ASKED = ("please draw the price label", "draw price labels at once", "open the host gate", "open host gates quickly", "water pumps drain", "")


def discovered(spark: SparkSession, sf: str) -> DataFrame:
    """PIP2, PIP4, FLT7, PRJ1, JN15, JN16, SRT2."""
    folder = samples.new_folder(spark)
    key = F.col("c_custkey")
    events = V.table(spark, sf, "customer").select(key.alias("ord"), F.format_string("c%d", key).alias("id"), F.lit("none").alias("capability"), F.lit("request").alias("kind"), F.lit("").alias("before"), samples.by_key(ASKED, key).alias("after"))
    samples.write_json(events, "corrections", folder)
    found = pipelines.discover(spark, sample_tree(spark, sf), folder)
    return found.select("capability", "label", "place", "rank", *FIELDS, "category", "integration", F.array_join("signals", ",").alias("signals"), F.size("member_ids").cast("long").alias("n_members"), F.col("member_ids")[0].alias("first_member"))


def reflection_cards(spark: SparkSession, sf: str) -> DataFrame:
    """PIP9, FLT14, FLT15, SRT4: what a display shows of both levels of the sweep, in its order."""
    rows = staged(view_evidence(spark, sf), "sweep-evidence")
    two, three = staged(presentation.by_baseline(sweeps.level2(rows)), "level2"), staged(sweeps.level3(rows), "level3")
    cards = presentation.stability_cards(two, three)
    printed = presentation.printed_designs(three).select("capability", F.lit(True).alias("is_printed"))
    return cards.join(printed, "capability", "left").select("capability", "place", "knob", *(S.rounded(F.col(c), 6).alias(c) for c in ("candidate_share", "min_share", "max_share", "l2_share")), "class_converges", F.coalesce("is_printed", F.lit(False)).alias("is_printed"))


def module_files(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that import the next one; some have a package of the same name, some a test."""
    k = F.col("p_partkey")
    text = F.format_string("from .m%d import f\n\ndef f():\n    pass\n", k + 1)
    paths = F.array_compact(F.array(F.format_string("pkg/m%d.py", k), F.when(k % 5 == 0, F.format_string("pkg/m%d/__init__.py", k)), F.when(k % 4 == 0, F.format_string("tests/test_m%d.py", k))))
    return lexers.lexed(V.parts(spark, sf).select(F.explode(paths).alias("path"), F.lit(".py").alias("ext"), text.alias("text")))


def module_places(spark: SparkSession, sf: str) -> DataFrame:
    """PIP8, AGG16, SRT5."""
    found = presentation.by_links(modules.roles(modules.module_map(module_files(spark, sf))))
    return found.select("path", "module", "n_defs", F.array_join("defs", ",").alias("defs"), "in_degree", "out_degree", "place")


def module_totals(spark: SparkSession, sf: str) -> DataFrame:
    """AGG15, AGG17."""
    files = staged(module_files(spark, sf), "lexed")
    return modules.totals(files, modules.roles(modules.module_map(files)))


def baseline_changes(spark: SparkSession, sf: str) -> DataFrame:
    """PIP7, SRC8, SNK3, PRJ2, FLT13, SRT3: the earlier half's readings, but for keys of unknown use, saved over an older baseline and compared with the later half's."""
    c, k, u, e = V.capabilities(spark, sf), staged(fields.capacity(V.capabilities(spark, sf), V.tokens(spark, sf)), "capacity"), fields.usage(V.usage(spark, sf)), V.corrections(spark, sf)
    before, now = (staged(readings(evidence(c, fields.demand(V.half(e, later)), k, u), V.scales(spark)), "readings") for later in (False, True))
    at = f"{samples.new_folder(spark)}/baseline"
    inputs.write_baseline(now, at)
    inputs.write_baseline(before.where("known"), at)
    found = presentation.by_change(changes.compared(inputs.read_baseline(spark, at), now))
    return found.select("capability", *(S.rounded(F.col(x), 6).alias(x) for x in ("d_collapse_potential", "d_correction", "d_utilization")), "verdict", "place")


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK1, SNK2, SNK4: a report written over an older one and read again, each row as JSON text."""
    at = f"{samples.new_folder(spark)}/last-report"
    scores = staged(view_readings(spark, sf).drop("evidence"), "readings")
    inputs.write_report(scores.limit(1), at)
    inputs.write_report(scores, at)
    text = inputs.as_json(spark.read.schema(scores.schema).json(at))
    value = {x: F.get_json_object("json", f"$.{x}") for x in ("capability", "score", "category", "rank")}
    return text.select(value["capability"].alias("capability"), value["score"].cast("double").alias("score"), value["category"].alias("category"), value["rank"].cast("int").alias("rank"))


def seeded(spark: SparkSession, sf: str) -> DataFrame:
    """SCL35: numbers in [0, 1) from texts."""
    return V.table(spark, sf, "part").select("p_partkey", S.uniform(F.col("p_name")).alias("u"))


QUERIES = {
    f.__name__: f
    for f in (
        tree_files, tree_lexers, import_forms, scan, quadrant, badges, symbol_distances, file_distances, discovered, reflection_cards, module_places, module_totals, baseline_changes, report_rows, seeded,
    )
}
