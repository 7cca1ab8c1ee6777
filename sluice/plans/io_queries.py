"""Queries of readers, sinks, keyed tables and streams, of components as data, and of report orders, with their SQL.

Each round trip writes to a scratch folder of the shared place and reads it back through the library's readers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import register_tables
from ..operators import datasets, mixers, reports, sampling, scorers
from ..scratch import Scratch, final
from ..sources import kv, readers, sinks
from ..streaming import mix_loop
from . import bindings
from .config import METHODS, preset, read_presets
from .contracts import Mixer, Reweighter, Scorer, Selector
from .queries import DOM, DOMAINS, OBS, POOL, PRIO, PROP, R, READY, RUNS, STAT, WIDE, COLS, H, T, _wide, big, query, r6
from .schedule import Schedule, domain_tag, stable_uid

_t = bindings.table


def _values(rows: list[tuple], columns: str) -> str:
    """A list of rows as SQL."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


def scratched(name: str, sql: str):
    """A query that gets a scratch folder; its result outlives it."""

    def keep(f):
        def run(s: SparkSession, d: str) -> DataFrame:
            with Scratch(s) as scratch:
                return final(f(s, d, scratch.place()))

        return query(name, sql)(run)

    return keep


# ---- components and presets as data

KINDS = (Scorer, Reweighter, Selector, Mixer)
#: name, timing and granularity of the built-in scorers
META = [("advantage_magnitude", "post_advantage", "prompt", 0), ("group_solve_rate", "post_reward", "prompt", 1), ("reward_difficulty", "post_reward", "prompt", 0), ("token_prob", "post_advantage", "token", 0)]


@query("components_scorers", _values(META, "name, timing, granularity, needs_groups"))
def _(s, d):
    made = [(n, Scorer.named(n)) for n, *_ in META if n in Scorer.names()]
    return s.createDataFrame([(n, c.timing, c.granularity, int(c.needs_groups)) for n, c in made], "name string, timing string, granularity string, needs_groups int")


ACTUATORS = [("mixer", n) for n in ("dump_ucb", "reward_gap", "static", "tscl")] + [("reweighter", n) for n in ("advantage_reweight", "difficulty_band", "per_advantage", "softmax")] + [("selector", n) for n in ("gfpo", "max_variance", "threshold_band", "topk_fraction")]


@query("components_actuators", _values(ACTUATORS, "kind, name"))
def _(s, d):
    return s.createDataFrame([(c.kind, n) for c in KINDS[1:] for n in c.names() if (c.kind, n) in ACTUATORS], "kind string, name string")


@query("components_columns", _values([("gfpo", "response_mask"), ("gfpo", "step"), ("gfpo", "l_linenumber"), ("gfpo", "uid"), ("gfpo", "rm_scores"), ("topk", "advantages"), ("topk", "response_mask"), ("topk", "step"), ("topk", "l_linenumber"), ("topk", "uid"), ("topk", "rm_scores")], "schedule, name"))
def _(s, d):
    b = bindings.rollouts(s, d)
    need = {n: Schedule.named(n, runtime={"tie": ("l_linenumber",)}).needed(b).columns for n in ("gfpo", "topk")}
    return s.createDataFrame([(n, c) for n, cs in need.items() for c in cs], "schedule string, name string")


SET = {"scorers": {"group_solve_rate": {"params": {"success_threshold": 0.75}}}, "mixers": {"static": {"params": {}}, "reward_gap": {"params": {"floor": 0.1, "note": "${who}'s"}}}}


@scratched("presets_of_a_file", _values([("mixer", "reward_gap", "floor", "0.1"), ("mixer", "reward_gap", "note", "run7's"), ("scorer", "group_solve_rate", "success_threshold", "0.75")], "kind, name, option, value"))
def _(s, d, at):
    import os
    import tempfile

    # a configuration file is the driver's own, not data
    with tempfile.TemporaryDirectory() as own:
        path = os.path.join(own, "presets.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(SET, f)
        table = read_presets(path)
    rows = [(k, n, o, str(v)) for k, of in table.items() for n in of for o, v in preset(k, n, table, {"who": "run7"}).items()]
    return s.createDataFrame(rows, "kind string, name string, option string, value string")


@query("presets_methods", _values([(n, None if m is None else m["mechanism"], None if m is None else m["scorer"]["name"], None if m is None else m["actuator"]["name"]) for n, m in METHODS.items()], "method, mechanism, scorer, actuator"))
def _(s, d):
    rows = []
    for n in METHODS:
        p = Schedule.named(n, runtime={"domains": DOMAINS})
        rows.append((n, p.plan.mechanism, p.scorer.name, p.actuator.name) if p else (n, None, None, None))
    return s.createDataFrame(rows, "method string, mechanism string, scorer string, actuator string")


@query("score_static_meta", "SELECT o_orderpriority AS domain, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1")
def _(s, d):
    out = scorers.StaticMeta("o_totalprice").score(_t(s, d, "orders"))
    return out.groupBy(F.col("o_orderpriority").alias("domain")).agg(F.round(F.avg("score"), 4).alias("score"))


@query("domain_tags", "SELECT 'domain' AS tagged_by, l_returnflag AS domain, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'data_source', source, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'none', 'default', count(*) FROM pages")
def _(s, d):
    named = lambda df, how: df.groupBy(F.lit(how).alias("tagged_by"), domain_tag(df).alias("domain")).agg(F.count("*").alias("n"))
    docs = _t(s, d, "documents").withColumnRenamed("source", "data_source")
    return named(bindings.rollouts(s, d), "domain").union(named(docs, "data_source")).union(named(_t(s, d, "pages"), "none"))


@query("prompt_uids", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderpriority) AS uid FROM orders")
def _(s, d):
    return _t(s, d, "orders").select("o_orderkey", stable_uid("o_orderkey", "o_orderpriority").alias("uid"))


# ---- readers and sinks


@scratched("io_parquet", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size % 2 = 0")
def _(s, d, at):
    p = _t(s, d, "part").select("p_partkey", "p_name", "p_size")
    sinks.write_parquet(p, at)
    sinks.write_parquet(p.where("p_size % 2 = 0"), at)
    sinks.write_parquet(p.limit(0), at, skip_existing=True)  # what is there stays
    return readers.read_parquet(s, at)


@scratched("io_jsonl", "SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM documents")
def _(s, d, at):
    docs = _t(s, d, "documents").select("doc_id", "lang", "text")
    lines = docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).union(s.createDataFrame([("",), ("  ",)], "value string"))
    lines.write.text(at)
    got = readers.read_jsonl(s, at, "doc_id bigint, lang string, text string").where("doc_id is not null")
    return got.select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@scratched("io_json_sink", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(s, d, at):
    rows = _t(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    sinks.write_json(rows, at)
    sinks.write_json(rows.limit(0), at, skip_existing=True)
    return readers.read_jsonl(s, at, "s_suppkey bigint, s_name string, s_acctbal double")


@scratched("io_csv", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name || ', \"' || c_mktsegment || '\"' END AS label, c_acctbal FROM customer")
def _(s, d, at):
    label = F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    sinks.write_csv(_t(s, d, "customer").withColumn("label", label), at, ["label", "c_acctbal", "c_custkey"])
    return readers.read_csv(s, at, "label string, c_acctbal double, c_custkey bigint")


@scratched("io_run_table", f"WITH {RUNS} SELECT method, CAST(seed AS BIGINT) AS seed, round(avg(acc), 6) AS math500, CAST(NULL AS DOUBLE) AS aime24 FROM runs GROUP BY ALL")
def _(s, d, at):
    r = bindings.runs(s, d).groupBy("method", "seed").agg(r6(F.avg("acc"), "math500"))
    fields = [x.split()[0] for x in readers.RUNS.split(", ")]
    sinks.write_csv(r.withColumns({c: F.lit(None).cast("string") for c in fields if c not in r.columns}), at, fields)
    return readers.read_runs(s, at).select("method", big(F.col("seed"), "seed"), "math500", "aime24")


@scratched("io_people_files", "SELECT n_name AS quiz, n_regionkey || ' knights' AS solution_text, CAST(n_regionkey + 3 AS BIGINT) AS n_people FROM nation")
def _(s, d, at):
    n = _t(s, d, "nation")
    for r in range(5):
        row = F.struct(F.col("n_name").alias("quiz"), F.concat(F.col("n_regionkey").cast("string"), F.lit(" knights")).alias("solution_text"))
        sinks.write_lines(n.where(F.col("n_regionkey") == r).select(F.to_json(row).alias("value")), f"{at}/people{r + 3}_test.jsonl")
    return readers.read_people(s, f"{at}/people*.jsonl").withColumn("n_people", big(F.col("n_people"), "n"))


@scratched("io_prompts", "SELECT conv_id, turn, text AS content, CASE WHEN turn % 3 = 0 THEN 'label ' || turn WHEN turn % 3 = 1 THEN 'answer' ELSE '' END AS ground_truth FROM conversations WHERE role = 'user'")
def _(s, d, at):
    c = _t(s, d, "conversations").where("role = 'user'")
    tag = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("tag").alias("role"), tag.alias("content")))
    kind = F.col("turn") % 3
    label, answer = F.when(kind == 0, F.concat(F.lit(" label "), F.col("turn").cast("string"))), F.when(kind < 2, " answer ")
    c.select(F.to_json(F.struct(prompt.alias("prompt"), label.alias("label"), answer.alias("answer"))).alias("value")).write.text(at)
    got = readers.read_prompts(s, at)
    of = lambda i: F.split(F.col("prompt")[1]["content"], " ")[i].cast("long")
    return got.select(of(0).alias("conv_id"), of(1).alias("turn"), F.col("prompt")[0]["content"].alias("content"), "ground_truth")


@scratched("io_eval_tree", "SELECT 'r' || n_regionkey AS scale, 'm_s1' AS run, 'nations' AS file_benchmark, CAST(count(*) AS BIGINT) AS n, round(avg(n_nationkey), 6) AS acc, CAST(sum(length(n_name)) AS BIGINT) AS chars FROM nation GROUP BY n_regionkey")
def _(s, d, at):
    n = _t(s, d, "nation")
    for r in range(5):
        per = F.collect_list(F.struct(F.lit(1.0).alias("acc"), F.lit(1.0).alias("score"), F.length("n_name").alias("resp_len"))).alias("per_row")
        one = n.where(F.col("n_regionkey") == r).agg(F.lit("m").alias("model"), F.lit("nations").alias("benchmark"), F.count("*").alias("n"), F.avg("n_nationkey").alias("acc"), per)
        sinks.write_lines(one.select(F.to_json(F.struct("*")).alias("value")), f"{at}/r{r}/m_s1/nations.json")
    got = readers.read_evals(s, f"{at}/*/*/*.json")
    return got.select("scale", "run", "file_benchmark", "n", r6(F.col("acc"), "acc"), F.aggregate("per_row", F.lit(0).cast("long"), lambda a, x: a + x["resp_len"]).alias("chars"))


@scratched(
    "io_metric_files",
    "SELECT CAST(s_suppkey AS VARCHAR) AS run, CASE s_suppkey % 5 WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN NULL ELSE s_suppkey / 4.0::DOUBLE END AS value FROM supplier WHERE s_suppkey % 3 = 0",
)
def _(s, d, at):
    """A file a supplier, with its metric in one of the accepted places, or without one."""
    form, x = F.col("s_suppkey") % 5, (F.col("s_suppkey") / 4).cast("string")
    said = (
        F.when(form == 0, F.concat(F.lit('{"acc": '), x, F.lit(', "score": 9}')))
        .when(form == 1, F.concat(F.lit('{"overall": {"accuracy": "'), x, F.lit('"}}')))
        .when(form == 2, F.concat(F.lit('{ "score": '), x, F.lit("}")))
        .when(form == 3, F.lit('{"overall": {"score": 0}}'))
        .otherwise(F.lit("{}"))
    )
    sinks.write_files(_t(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("run"), said.alias("value")), at, ("run",))
    return readers.read_metrics(s, f"{at}/run=*/*").select(F.regexp_extract("path", r"run=(\w+)/", 1).alias("run"), "value")


LEAVES = """SELECT p_partkey, unnest(CASE p_size % 5 WHEN 0 THEN [{'metric': 'acc', 'value': p_size * 1.0::DOUBLE}, {'metric': 'overall.score', 'value': 0.0::DOUBLE}]
   WHEN 1 THEN [{'metric': 'overall.by domain.' || p_brand, 'value': p_size / 2.0::DOUBLE}] WHEN 2 THEN [{'metric': 'acc', 'value': p_size / 4.0::DOUBLE}] ELSE [] END, recursive := true) FROM part"""


@query("io_metric_leaves", LEAVES)
def _(s, d):
    """Metrics of JSON whose keys nobody lists: numbers and numbers as text at any depth, null and other values none."""
    n = F.col("p_size")
    said = (
        F.when(n % 5 == 0, F.format_string('{"acc": %d, "overall": {"score": 0, "note": "x", "by domain": null}}', n.cast("long")))
        .when(n % 5 == 1, F.concat(F.lit('{"overall": {"by domain": {"'), F.col("p_brand"), F.lit('": "'), (n / 2).cast("string"), F.lit('"}}, "acc": null}')))
        .when(n % 5 == 2, F.concat(F.lit('{"acc": '), (n / 4).cast("string"), F.lit(', "list": [1, 2], "flag": true}')))
        .when(n % 5 == 3, F.lit('{"acc": '))
    )
    return readers.metric_leaves(_t(s, d, "part").select("p_partkey", said.alias("said")), "said", ("p_partkey",))


@scratched("io_marked_lines", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS number FROM part WHERE p_size % 3 = 0")
def _(s, d, at):
    p = _t(s, d, "part")
    p.select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, "exact_match,none").otherwise("other"), F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("value")).write.text(at)
    got = readers.read_marked_lines(s, at, "exact_match")
    return got.select(F.split("line", ",")[0].cast("long").alias("p_partkey"), "number")


@scratched("io_job_list", "SELECT 's' || c_nationkey AS scale, c_name AS name, CAST(c_custkey AS BIGINT) AS seed, CASE WHEN c_custkey % 2 = 0 THEN 'a|b c' ELSE '' END AS args FROM customer")
def _(s, d, at):
    c = _t(s, d, "customer")
    job = F.concat_ws("|", F.concat(F.lit("s"), F.col("c_nationkey").cast("string")), "c_name", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "a|b c").otherwise(""))
    c.select(job.alias("value")).union(s.createDataFrame([("# comment|x|1|y",), ("",), ("  # more",)], "value string")).write.text(at)
    return readers.read_jobs(s, at).withColumn("seed", big(F.col("seed"), "seed"))


@query("io_text_table", "SELECT 0 AS line, '| r_regionkey | r_name |' AS said UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT CAST(r_regionkey + 2 AS INT), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def _(s, d):
    said = sinks.text_table(_t(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")).split("\n")
    return s.createDataFrame(list(enumerate(said)), "line int, said string")


@scratched("kv_round_trip", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 2 = 0")
def _(s, d, at):
    c = _t(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), "c_name")
    kv.put(c, at, "c_custkey", 1)
    kv.put(c.where("c_custkey % 3 = 0").withColumn("balance", F.col("balance") * 2), at, "c_custkey", 2)
    kv.put(c.where("c_custkey % 3 = 0").withColumn("balance", F.col("balance") * 2), at, "c_custkey", 2)  # repeated, as after a failure
    return kv.get(s, at, c.where("c_custkey % 2 = 0").select("c_custkey"), ["c_custkey", "balance"])


# ---- data sets and reports


@query("ds_where_equal", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def _(s, d):
    return datasets.where_equal(_t(s, d, "customer"), c_mktsegment="BUILDING", c_nationkey=3, c_name=None).select("c_custkey")


@query("ds_strip_tail", "SELECT doc_id, CASE WHEN contains(text, ' the ') THEN length(regexp_replace(string_split(text, ' the ')[1], '[ \\t\\n\\r\\f\\v]+$', '')) ELSE length(text) END + 6 AS chars FROM documents WHERE text IS NOT NULL")
def _(s, d):
    docs = _t(s, d, "documents").where("text is not null")
    return docs.select("doc_id", F.length(datasets.strip_tail(F.col("text"), " the ", "Go on")).cast("long").alias("chars")).withColumn("chars", F.col("chars") - 1)


@query("ds_numbers", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN p_size * 100.0::DOUBLE ELSE p_size * 50.0::DOUBLE END AS share FROM part")
def _(s, d):
    k = F.col("p_size") % 4
    text = F.when(k == 0, "  ").when(k == 1, "n/a").when(k == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise((F.col("p_size") / 2).cast("string"))
    return datasets.percent(_t(s, d, "part").select("p_partkey", datasets.number(text).alias("share")), "share")


@query("ds_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def _(s, d):
    return datasets.union_distinct(_t(s, d, "customer").select(F.col("c_nationkey").alias("nation")), _t(s, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("ds_shuffle_head", f"SELECT o_orderkey FROM orders ORDER BY {H.format('o_orderkey + 11')}, o_orderkey LIMIT 200")
def _(s, d):
    return sampling.shuffled(_t(s, d, "orders").select("o_orderkey"), "o_orderkey", seed=11).limit(200)


@query("ds_message_rows", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS seq, role, text AS content FROM conversations")
def _(s, d):
    return datasets.message_rows(_t(s, d, "conversations"))


@query("rows_with_outputs", "SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(s, d):
    out = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_linenumber", "l_quantity")
    return reports.with_outputs(_t(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority"), out).withColumnRenamed("row_id", "o_orderkey")


MEAN_B1 = f"WITH {WIDE} SELECT scale, method, CAST(seed AS BIGINT) AS seed, round(b1, 6) AS b1 FROM x"


def _b1(s, d):
    return _wide(s, d).select("scale", "method", big(F.col("seed"), "seed"), r6(F.col("b1"), "b1"))


@query("report_ranked", f"{MEAN_B1} ORDER BY coalesce(b1, 0) DESC, scale, method, seed LIMIT 9")
def _(s, d):
    return reports.ranked(_b1(s, d), "b1", "scale", "method", "seed").limit(9)


@query("report_in_order", f"{MEAN_B1} ORDER BY scale NULLS FIRST, method NULLS FIRST, seed NULLS FIRST LIMIT 9")
def _(s, d):
    return reports.in_order(_b1(s, d), "scale", "method", "seed").limit(9)


@query("report_display_order", f"{MEAN_B1} ORDER BY CASE method WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, method, scale, seed LIMIT 20")
def _(s, d):
    return reports.display_order(_b1(s, d), "method", ["5-LOW", "2-HIGH"], "scale", "seed").limit(20)


@query("report_progress", f"WITH {RUNS} SELECT count(DISTINCT method || '_s' || seed) AS n_done, count(DISTINCT method || '_s' || seed) >= 30 AS finished FROM runs")
def _(s, d):
    return reports.progress(bindings.runs(s, d).withColumn("run", F.concat_ws("_s", "method", F.col("seed").cast("string"))), 30)


# ---- quotas where domains run short

SHORT = "(domain = '5-LOW' AND uid % 4 = 0 OR domain IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND uid % 10 = 0 OR domain = '4-NOT SPECIFIED')"


@query(
    "quota_shortfall",
    f"""WITH {POOL}, {READY}, k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY step, uid) AS rn FROM ready WHERE {SHORT}),
  t AS (SELECT * FROM (VALUES (0, '1-URGENT', 1002), (1, '2-HIGH', 501), (2, '3-MEDIUM', 250), (3, '5-LOW', 250)) v(domain_ord, domain, target)),
  j AS (SELECT k.*, t.domain_ord, CASE WHEN target IS NULL THEN 2 WHEN rn <= target THEN 0 ELSE 1 END AS phase FROM k LEFT JOIN t USING (domain))
  SELECT uid, domain, CAST(phase AS BIGINT) AS phase FROM (SELECT * FROM j ORDER BY phase, CASE WHEN phase < 2 THEN domain_ord ELSE 0 END, step, uid LIMIT 2003)""",
)
def _(s, d):
    pool = sampling.sampleable(bindings.prompt_pool(s, d)).where(SHORT)
    rows = s.createDataFrame([(i, n, p) for i, (n, p) in enumerate(zip(PRIO, PROP))], "domain_ord int, domain string, p double")
    return sampling.quota_sample(pool, sampling.quota_targets(rows, 2003), 2003).select("uid", "domain", big(F.col("phase"), "phase"))


@scratched("quota_of_published", f"WITH {STAT}, l AS (SELECT domain, arg_max(mean, row(ts, event_id)) AS mean FROM w GROUP BY domain), {DOM}, j AS (SELECT d.*, coalesce(mean, 0) AS mean FROM d LEFT JOIN l USING (domain)), x AS (SELECT *, max(mean) OVER () - mean AS x FROM j), e AS (SELECT *, exp(x - max(x) OVER ()) AS e FROM x), p AS (SELECT *, greatest(e / sum(e) OVER (), 0.05) AS p FROM e), q AS (SELECT domain_ord, domain, p / sum(p) OVER () AS p FROM p), b AS (SELECT *, floor(p * 777) AS b, round(p * 777 - floor(p * 777), 12) AS f FROM q) SELECT domain_ord, domain, CAST(b + CASE WHEN row_number() OVER (ORDER BY f DESC, domain_ord) <= 777 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS target FROM b")
def _(s, d, at):
    """The mixer publishes proportions to a keyed table, and the sampler takes its quotas from there."""
    stats = mixers.latest(mixers.domain_windows(bindings.observations(s, d)))
    kv.put(mixers.RewardGap(DOMAINS).mix(stats), at, "domain", 1)
    return sampling.quota_targets(kv.get(s, at), 777).select(big(F.col("domain_ord"), "domain_ord"), "domain", "target")


@query("tracker_domains", f"WITH {OBS} SELECT DISTINCT domain FROM o")
def _(s, d):
    return mixers.domains_seen(bindings.observations(s, d))


@query("ds_epochs", "SELECT s_suppkey, epoch FROM supplier, (SELECT unnest(range(3)) AS epoch)")
def _(s, d):
    return datasets.epochs(_t(s, d, "supplier").select("s_suppkey"), 3).withColumn("epoch", big(F.col("epoch"), "epoch"))


# ---- functions as components


@query("mix_function", f"WITH {STAT}, l AS (SELECT domain, arg_max(mean, row(ts, event_id)) AS mean FROM w GROUP BY domain), {DOM}, x AS (SELECT d.domain_ord, d.domain, coalesce(mean, 0) / 2 AS x FROM d LEFT JOIN l USING (domain)), e AS (SELECT *, exp(x - max(x) OVER ()) AS e FROM x), p AS (SELECT *, greatest(e / sum(e) OVER (), 0.05) AS p FROM e) SELECT domain_ord, domain, round(p / sum(p) OVER (), 6) AS p FROM p")
def _(s, d):
    stats = mixers.latest(mixers.domain_windows(bindings.observations(s, d)))
    m = mixers.FunctionMixer(DOMAINS, lambda rows: rows["mean"] / 2, {"mean": 0.0}).mix(stats)
    return m.select(big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


@query("log_metric_udtf", "SELECT event_id, 'm_' || event_type AS metric, round(value, 2) AS number FROM events UNION ALL SELECT event_id, 'm_n', 1.0 FROM events")
def _(s, d):
    register_tables(s)
    line = F.concat(F.lit("step 1 m_"), "event_type", F.lit(":"), F.col("value").cast("string"), F.lit(" other:1 m_n:1"))
    lines = _t(s, d, "events").select("event_id", line.alias("line"))
    return s.sql("SELECT event_id, metric, round(number, 2) AS number FROM {lines}, LATERAL metric_rows(line, 'm_')", lines=lines)


# ---- streams: events in three files, a micro-batch each


def _arriving(e: DataFrame, at: str, parts: int = 3) -> Iterator[int]:
    """Writes the rows in as many parts of rising steps, one after the other, and stops behind each: a stream that runs there takes it as one micro-batch.

    A part is as many files as tasks wrote it, so that none of them reads or writes it whole.
    """
    days = [r[0] for r in e.select(F.explode(F.percentile_approx("step", [i / parts for i in range(1, parts)]))).collect()]
    for i, (lo, hi) in enumerate(zip([None, *days], [*days, None])):
        part = e.where((F.lit(True) if lo is None else F.col("step") > lo) & (F.lit(True) if hi is None else F.col("step") <= hi))
        part.write.mode("append").parquet(at)
        yield i


def _stream(s: SparkSession, at: str, schema) -> DataFrame:
    """All that is new in a folder as one micro-batch, however many files it is."""
    return s.readStream.schema(schema).parquet(at)


LATEST = "l AS (SELECT domain, arg_max(mean, row(ts, event_id)) AS mean, arg_max(slope, row(ts, event_id)) AS slope, count(*) AS n FROM w GROUP BY domain)"


@scratched("stream_domain_stats", f"WITH {STAT}, {LATEST} SELECT domain, n AS count, round(mean, 6) AS mean, round(slope, 6) AS slope FROM l")
def _(s, d, at):
    e = _observed(s, d)
    out = f"{at}/out"
    for _ in _arriving(e, f"{at}/in"):
        stats = mix_loop.domain_stats_stream(_stream(s, f"{at}/in", e.schema))
        q = stats.writeStream.outputMode("update").foreachBatch(lambda b, i: kv.put(b, out, "domain", i)).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return kv.get(s, out).select("domain", "count", r6(F.col("mean"), "mean"), r6(F.col("slope"), "slope"))


def _observed(s: SparkSession, d: str) -> DataFrame:
    """Observations with a sortable row_id: the event's time and number as one text."""
    o = bindings.observations(s, d)
    return o.select("step", F.concat_ws("/", F.date_format("row_id.ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("row_id"), "domain", "value")


MIXED = f"""WITH {STAT}, {LATEST}, {DOM}, x AS (SELECT d.domain_ord, d.domain, l.mean FROM d LEFT JOIN l USING (domain)),
  y AS (SELECT *, max(coalesce(mean, 0)) OVER () - coalesce(mean, 0) AS x FROM x), e AS (SELECT *, exp(x - max(x) OVER ()) AS e FROM y),
  p AS (SELECT *, greatest(e / sum(e) OVER (), 0.05) AS p FROM e) SELECT domain_ord, domain, round(p / sum(p) OVER (), 6) AS p FROM p"""


@scratched("stream_mix_restart", MIXED)
def _(s, d, at):
    """The loop runs over the first files, ends, and starts again on the rest: its last proportions are those of all rows."""
    e = _observed(s, d)
    src, out = f"{at}/in", f"{at}/out"
    half = e.agg(F.percentile_approx("step", 0.5)).first()[0]

    def publish(p: DataFrame, step: int) -> None:
        kv.put(p, out, "domain", step)

    for part in (e.where(F.col("step") <= half), e.where(F.col("step") > half)):
        for _ in _arriving(part, src, 2):
            mix_loop.start_mix_loop(_stream(s, src, e.schema), mixers.RewardGap(DOMAINS), publish, f"{at}/check", availableNow=True).awaitTermination()
    return kv.get(s, out).select(big(F.col("domain_ord"), "domain_ord"), "domain", r6(F.col("p"), "p"))


@scratched("stream_weights", f"WITH {R}, s AS (SELECT *, avg(CASE WHEN reward > 0.5 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY step, uid) AS score FROM r) SELECT step, count(*) AS n, round(avg(CASE WHEN score > 0.2 AND score < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS kept_frac FROM s GROUP BY step")
def _(s, d, at):
    """Weights of batches as they come, written back and read again."""
    b = bindings.rollouts(s, d)
    for _ in _arriving(b, f"{at}/in"):
        Schedule.named("difffilter", runtime={"tie": T}).write_stream(_stream(s, f"{at}/in", b.schema), f"{at}/out", f"{at}/check", availableNow=True).awaitTermination()
    return readers.read_parquet(s, f"{at}/out").groupBy("step").agg(F.count("*").alias("n"), r6(F.avg(F.col("kept").cast("double")), "kept_frac"))


@scratched("stream_event_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d, at):
    e = _t(s, d, "events").select("ts", "event_type", "value")
    out = f"{at}/out"
    for _ in _arriving(e.withColumn("step", F.unix_date(F.to_date("ts"))), f"{at}/in"):
        w = mix_loop.windowed_event_stats(_stream(s, f"{at}/in", e.schema))
        w = w.select(F.concat_ws("|", F.col("window.start").cast("string"), "event_type").alias("id"), F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
        q = w.writeStream.outputMode("update").foreachBatch(lambda b, i: kv.put(b, out, "id", i)).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return kv.get(s, out).drop("id")
