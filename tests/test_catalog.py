import itertools
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import catalog, lineage


def test_script_idioms(spark):
    scripts = [
        ("copy", 'a = spark.table("Raw.A")\nb = spark.read.table(\'x.y\')\na.write.saveAsTable("cur.C")\nspark.table("cur.c")'),
        ("sink", 'x.setCatalogInfo(catalogDatabase="Gold", catalogTableName="T")'),
        ("jdbc", 'r = spark.read.option("dbtable", "CRM.CALL").load()\n' + "#" * 260 + '\nr.write.option("dbtable","CRM.COPY").save()'),
        ("options", '.options(sfTable="S.T")'),
        ("sql", 'spark.sql("insert overwrite table g.t select * from a.b join c.d on 1=1")'),
        ("cte", 'spark.sql("with q as (select * from a.b) select * from q")'),
        ("path", 'spark.read.parquet("s3://B/Raw/x")\nd.write.save("s3://b/out/x")'),
        ("keyword", 'p = "s3://b/curated/x"\nq = "s3://b/landing/x"'),
        ("template", 'f = "s3://{b}/{t}/"'),
        ("empty", None)]
    io = lineage.extract_io(spark.createDataFrame(scripts, "name string, text string"))
    got = {r["name"]: (r["reads"], r["writes"], r["external"]) for r in io.collect()}
    assert got == {
        "copy": (["raw.a", "x.y"], ["cur.c"], False), "sink": ([], ["gold.t"], False),
        "jdbc": (["crm.call"], ["crm.copy"], True), "options": (["s.t"], [], False),
        "sql": (["a.b", "c.d"], ["g.t"], False), "cte": (["a.b"], [], False),
        "path": (["s3://b/raw/x"], ["s3://b/out/x"], True), "keyword": (["s3://b/landing/x"], ["s3://b/curated/x"], True),
        "template": ([], [], True), "empty": ([], [], False)}


def brute_resolve(ref, names):
    norm = ref.lower()
    exact = [n for n in names if n.lower() == norm]
    if exact:
        return exact[0]
    same = [n for n in names if n.lower().split(".")[-1] == norm.split(".")[-1]]
    score = sorted((len(set(norm.split(".")) & set(n.lower().split("."))) for n in same), reverse=True)
    if not same or (len(score) > 1 and score[0] == score[1]):
        return None
    return max(same, key=lambda n: len(set(norm.split(".")) & set(n.lower().split("."))))


def test_resolution_against_brute_force(spark):
    rng = random.Random(2)
    name = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    names, refs = sorted({name() for _ in range(60)}), sorted({name().upper() for _ in range(80)})
    out = lineage.resolve_reference(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(n,) for n in names], "full_name string"))
    assert {r["ref"]: r["full_name"] for r in out.collect()} == {r: brute_resolve(r, names) for r in refs}


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("w", "x"), ("c", "d"), ("q", "r")]


def test_closure_ends_on_cycles_and_refuses_to_be_cut(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    targets = spark.createDataFrame([("b",), ("b",)], "id string")
    closure = lineage.upstream_closure(edges, targets)
    assert rows(closure) == [("a", 1), ("b", 0), ("c", 2), ("w", 2), ("x", 1)]
    assert rows(lineage.closure_edges(edges, closure)) == [("a", "b"), ("b", "c"), ("c", "a"), ("w", "x"), ("x", "b")]
    with pytest.raises(ValueError):
        lineage.upstream_closure(edges, targets, max_depth=1)


def test_levels_flag_cycles_and_what_follows_them(spark):
    out = lineage.topo_levels(spark.createDataFrame([*EDGES, ("s", "s"), ("w", "t"), ("x", "t")], "src string, dst string"))
    assert rows(out) == sorted([("q", 0, False), ("r", 1, False), ("w", 0, False), ("x", 1, False), ("t", 2, False)]
                               + [(n, None, True) for n in "abcds"], key=repr)


def test_duplicates_in_small_blocks_against_brute_force(spark):
    rng = random.Random(9)
    tables = [(f"s{i}.{rng.choice('ttu')}", rng.choice(["lake", "warehouse"]), rng.sample("ABCDEFG", rng.randint(0, 5))) for i in range(60)]
    df = spark.createDataFrame(tables, "full_name string, system string, columns array<string>")
    expected = {}
    for base in "tu":
        group = [t for t in tables if t[0].endswith(base)]
        sets = [set(c) for _, _, c in group if c]
        ratio = min(len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2))
        expected[base] = (len(group), len({s for _, s, _ in group}) > 1, round(ratio, 2))
    for block in (2, 7, 1000):
        assert {r[0]: tuple(r)[1:] for r in catalog.find_duplicates(df, block).collect()} == expected


def test_contained_names_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab_") for _ in range(rng.randint(1, 7)))
    cells, jobs = sorted({word() for _ in range(60)}), sorted({word() for _ in range(25)})
    base = lambda s: "_".join(p for p in s.split("_") if p)
    expected = {}
    for c in cells:
        known = {base(j): min(k for k in jobs if base(k) == base(j)) for j in jobs if base(j)}
        if base(c) in known:
            expected[c] = known[base(c)]
        elif base(c) and (near := [b for b in known if b in base(c) or base(c) in b]):
            expected[c] = known[min(near)]
    out = catalog.contains_match_job(spark.createDataFrame([(c,) for c in cells], "value string"), spark.createDataFrame([(j,) for j in jobs], "job string"))
    assert {r["value"]: r["job"] for r in out.collect()} == expected


def ops(spark, jobs, tables, names):
    jobs = spark.createDataFrame(jobs, "key string, legacy_name string, depends_on array<string>")
    cells = None
    for name, canonical, schema, data in tables:
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"n int, {schema}")
        part = catalog.config_cells(df, name, canonical, "n")
        cells = part if cells is None else cells.unionByName(part)
    known = spark.createDataFrame([(n, "lake") for n in names], "full_name string, system string")
    return catalog.ops_graph(jobs, cells, known)


def test_operations_graph(spark):
    graph = ops(spark, [("load_cfg", "load_confiq", []), ("raw", "landing_to_raw", ["load_cfg"]), ("cur", "raw_to_curated", ["raw"]),
                        ("pub", "curated_to_publish", ["cur"])],
                [("query_configuration", "query_configuration", "interface string, source_tablename string, target_tablename string, sql_query string",
                  [("raw_to_curated", "raw_account", "account", "select 1"), ("curated_to_publish", "account", "dim_account", "select 2")]),
                 ("parent_batch_process", "parent_batch_process", "parent_batch_id string, source_system string", [("b1", "raw_to_curated")])],
                ["crm_silver.account", "crm_gold.dim_account", "crm_silver.orphan_tbl"])
    edges = {(r["src"], r["dst"], r["kind"], r["label"]) for r in graph.edges.collect()}
    assert sum(k == "execution" for _, _, k, _ in edges) == 3
    assert {("tbl:account", "job:curated_to_publish", "data", ""), ("job:curated_to_publish", "tbl:dim_account", "data", ""),
            ("job:raw_to_curated", "ctl:parent_batch_process", "control", "writes"),
            ("job:raw_to_curated", "ctl:query_configuration", "control", "reads")} <= edges
    health = {(r["kind"], r["detail"]) for r in graph.health.collect()}
    assert ("orphan_table", "crm_silver.orphan_tbl") in health and ("missing_table", "raw_account") in health
    assert ("job_no_logic", "load_confiq") in health


def test_operations_graph_with_other_names(spark):
    graph = ops(spark, [("a", "step_alpha", []), ("b", "step_beta", ["a"])],
                [("query_config", "query_configuration", "job string, src_table string, tgt_table string", [("step_beta", "widgets_raw", "widgets_final")])],
                ["lake.widgets_raw", "lake.widgets_final"])
    data = {(r["src"], r["dst"]) for r in graph.edges.where("kind = 'data'").collect()}
    assert data == {("tbl:widgets_raw", "job:step_beta"), ("job:step_beta", "tbl:widgets_final")}


def test_control_tables_by_name_and_columns(spark):
    tables = {"tbl_rules_commercial": ["rule_name", "rule_type", "table_name", "severity", "created_at"], "two_hints": ["rule_name", "severity"],
              "customers": ["id", "name", "email"], "public.Config-Master": ["id"], "cdl_ingestion_log": ["x"]}
    cols = spark.createDataFrame([(t, c) for t, cs in tables.items() for c in cs], "table string, col_name string")
    assert rows(catalog.classify_control_table(cols)) == [
        ("cdl_ingestion_log", "cdl_ingestion_log", "name"), ("public.Config-Master", "configuration_master", "name"),
        ("tbl_rules_commercial", "dq_rules", "columns")]


def test_lineage_graph(spark):
    cat = spark.createDataFrame([("CRM.PUBLIC.CALL", "warehouse", "table"), ("CRM.PUBLIC.V_CALL", "warehouse", "view"), ("raw_db.call", "lake", "table")],
                                "full_name string, system string, kind string")
    scripts = spark.createDataFrame([("load", 'spark.read.csv("s3://in/landing/f")\ndf.write.saveAsTable("raw_db.call")'), ("idle", "print(1)")], "name string, text string")
    views = spark.createDataFrame([("CRM.PUBLIC.V_CALL", "select * from public.call join dim_x")], "full_name string, sql string")
    rels = spark.createDataFrame([("CRM.PUBLIC.CALL", "raw_db.call"), ("CRM.PUBLIC.CALL", "CRM.GONE")], "fk_table string, pk_table string")
    graph = lineage.build_lineage(cat, scripts, views, rels)
    assert rows(graph.edges) == sorted([
        ("ref:s3://in/landing/f", "job:load", ""), ("job:load", "lake:raw_db.call", ""), ("warehouse:crm.public.call", "warehouse:crm.public.v_call", "view"),
        ("ref:dim_x", "warehouse:crm.public.v_call", "view"), ("lake:raw_db.call", "name:call", "load"),
        ("name:call", "warehouse:crm.public.call", "same_name"),
        ("warehouse:crm.public.call", "lake:raw_db.call", "fk")], key=repr)
    types = {r["id"]: r["type"] for r in graph.nodes.collect()}
    assert types["ref:dim_x"] == "source" and types["warehouse:crm.public.v_call"] == "gold" and types["lake:raw_db.call"] == "bronze"
    assert "job:idle" not in types and len(types) == graph.nodes.count()
    assert set(types) >= {r["src"] for r in graph.edges.collect()} | {r["dst"] for r in graph.edges.collect()}


def test_names_of_both_sides_meet_in_a_hub(spark):
    cat = spark.createDataFrame([(f"raw{i}.t", "lake", "table") for i in range(5)] + [(f"w{i}.T", "warehouse", "table") for i in range(4)]
                                + [("raw.alone", "lake", "table"), ("w.other", "warehouse", "view")], "full_name string, system string, kind string")
    got = {(r["src"], r["dst"]) for r in lineage.name_match_edges(cat).collect()}
    assert got == {(f"lake:raw{i}.t", "name:t") for i in range(5)} | {("name:t", f"warehouse:w{i}.t") for i in range(4)}


def test_review_marks(spark):
    art = spark.createDataFrame([("models", "m", "select 1 -- TODO[Assumption]: check\n# FIXME", ), ("notebook", "n", "LISTAGG(x)"), ("models", "s", "-- generated scaffold")],
                                "kind string, name string, text string")
    assert rows(catalog.review_queue(art), "name", "tag", "line", "detail") == [
        ("m", "ASSUMPTION", 1, "check"), ("m", "TODO", 2, "# FIXME"), ("s", "NEEDS-AI", 0, "not translated")]
    assert catalog.review_queue(art).where(F.col("name") == "n").count() == 0


@pytest.mark.parametrize(("sql", "tables"), [
    ("with a as (select * from x), b as (select * from a) select * from b join a join c", ["x", "c"]),
    ("with a as (select * from a) select * from a", ["a"]),
    ("with recursive a as (select 1 union all select * from a), b as (select * from b) select * from a, b", []),
    ("with a as (select 1) select * from a; select * from a", ["a"]),
    ("select * from (with a as (select * from q) select * from a) s join a on s.k = a.k", ["q", "a"]),
    ("with a as (with b as (select * from x) select * from b) select * from a join b", ["x", "b"]),
    ("with a (k, v) as not materialized (select k, (select max(v) from y) from x) , B as (select 1) select * from \"b\" join `A`", ["y", "x"]),
    ("insert into t select * from s where k in (select k from u) -- with s as (\n and 'from lies' = '(('", ["s", "u"]),
    ("select * from a)) ; with a as (select 1) select * from a, b", ["a", "b"]),
    ("", []), (None, [])])
def test_cte_names_hide_tables_in_their_scope_only(spark, sql, tables):
    df = spark.createDataFrame([(1, sql)], "name int, sql string")
    assert df.select(lineage.sql_tables("sql")).first()[0] == tables


def test_long_references_go_by_number(spark):
    filler = ".".join(f"x{i}" for i in range(60))
    refs = [(f"{filler}.w{i % 3}.k{i}.t",) for i in range(300)] + [(None,), ("w1.t",), ("s3://b/w1.t",), (f"{filler}.u",)]
    tables = spark.createDataFrame([("w0.t",), ("W1.t",), ("w2.t",), ("w2.\"T\"",), (None,)], "full_name string")
    out = lineage.resolve_reference(spark.createDataFrame(refs + refs[:5], "ref string"), tables)
    want = {r: f"w{i % 3}.t".replace("w1", "W1").replace("w2.t", 'w2."T"') for i, (r,) in enumerate(refs[:300])}
    assert {r["ref"]: r["full_name"] for r in out.collect()} == {**want, None: None, "w1.t": "W1.t", "s3://b/w1.t": None, f"{filler}.u": None}
    # no text of a reference is a key of an aggregate or join below the distinct references
    grouped = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x or "Join" in x]
    assert grouped and not any(word in x for x in grouped for word in ("asked", "parts", "norm"))


def test_texts_of_one_small_file_are_dealt_over_tasks(spark):
    from lakeproof.suite.lineage import scripts_of
    part = spark.range(40).selectExpr("id as p_partkey", "concat('name ', id) as p_name", "'PROMO' as p_type", "1 as p_size").coalesce(1)
    assert lineage.extract_io(scripts_of(part)).rdd.getNumPartitions() > 1
    views = part.select("p_name", F.lit("select * from a.b").alias("q"))
    out = lineage.extract_sql_tables(views, "p_name", "q")
    assert out.rdd.getNumPartitions() > 1 and rows(out) == sorted((f"name {i}", "a.b") for i in range(40))


def test_jobs_are_extracted_once(spark):
    scripts = spark.createDataFrame([("a", 'spark.table("x.y")'), ("a", 'spark.table("x.z")'), (None, None)], "name string, text string")
    out = lineage.classify_jobs(lineage.extract_io(scripts), spark.createDataFrame([("x.y",)], "full_name string"), scripts)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 0
    assert rows(out) == sorted([("a", "ingestion")] * 4 + [(None, "ingestion")], key=repr)
