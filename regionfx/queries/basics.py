"""Scans, projections, filters, limits, set operations and scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionfx.catalog import query, table
from regionfx.functions import scalars as S
from regionfx.operators import aggregates as A
from regionfx.operators import sampling as L
from regionfx.sources import tables as T
from regionfx.storage import new_folder as _folder


@query("s1_read_table", "SELECT o_orderkey AS order_id, o_orderstatus AS outcome, o_totalprice AS score FROM orders")
def s1(spark, d):
    return T.read_table(spark, f"{d}/orders.parquet", rename={"o_orderkey": "order_id", "o_orderstatus": "outcome", "o_totalprice": "score"}, select=["order_id", "outcome", "score"])


@query("s2_read_tsv_skip", "SELECT n_nationkey, n_name FROM nation")
def s2(spark, d):
    path = _folder(spark, "tsv")
    lines = table(spark, d, "nation").select(F.concat_ws("\t", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    head = lines.limit(1).select(F.explode(F.array(F.lit("preamble"), F.lit("7\tno comment sign\t8"))).alias("value"))
    head.union(lines).coalesce(1).write.text(path)
    return T.read_tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int", usecols=["n_nationkey", "n_name"], skip=2)


@query("s3_read_whitespace", "SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, nullif(split_part(p_name, ' ', 2), '') AS thing FROM part")
def s3(spark, d):
    return table(spark, d, "part").select("p_partkey", *T.whitespace_fields(F.col("p_name"), ["colour", "thing"]))


@query("s4_read_many", "SELECT 'nation' AS source_table, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def s4(spark, d):
    a = T.read_many(spark, f"{d}/nation.parquet", "source_table", r"^(\w+)\.parquet").select("source_table", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    b = T.read_many(spark, f"{d}/region.parquet", "source_table", r"^(\w+)\.parquet").select("source_table", F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return L.union_by_name(a, b)


@query("s5_match_files", "SELECT page_id, n_name FROM pages, (SELECT DISTINCT '/' || lang || '/' AS n_name FROM documents) WHERE contains(url, n_name) AND contains(url, 'example')")
def s5(spark, d):
    wanted = table(spark, d, "documents").select(F.concat(F.lit("/"), "lang", F.lit("/")).alias("n_name")).distinct()
    return T.match_files(table(spark, d, "pages"), wanted, "url", "n_name", must="example").select("page_id", "n_name")


@query("s5_match_many", "SELECT c_name, part FROM customer, (SELECT DISTINCT substr((p_partkey * 7919 % 100000)::VARCHAR, 1, 2 + p_partkey % 4) AS part FROM part) WHERE contains(c_name, part)")
def s5_many(spark, d):
    part = F.substring((F.col("p_partkey") * 7919 % 100_000).cast("string"), F.lit(1), (F.col("p_partkey") % 4 + 2).cast("int"))
    wanted = table(spark, d, "part").select(part.alias("part")).distinct()
    return T.match_files(table(spark, d, "customer"), wanted, "c_name", "part").select("c_name", "part")


@query("s6_read_fasta", "SELECT item_id::VARCHAR AS id, regexp_replace(regexp_replace(text, '>', '', 'g'), '\\s', '', 'g') AS seq FROM benchmark")
def s6(spark, d):
    path = _folder(spark, "fasta")
    table(spark, d, "benchmark").select(F.concat(F.lit(">sp|"), "item_id", F.lit("|NAME\n"), F.regexp_replace("text", ">", "")).alias("value")).write.text(path)
    return T.read_fasta(spark, path)


@query("s6_fasta_headers", "SELECT doc_id::VARCHAR AS id, regexp_replace(text, '[^a-z]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL")
def s6_headers(spark, d):
    """Headers that hold the sign of a record, line ends of both kinds."""
    path, sequence = _folder(spark, "fasta"), F.regexp_replace("text", "[^a-z]", "")
    lines = F.regexp_replace(sequence, "(.{60})", "$1\r\n")
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    rows.select(F.concat(F.lit(">sp|"), "doc_id", F.lit("|a->b > c>\r\n"), lines, F.lit("\r")).alias("value")).write.text(path)
    return T.read_fasta(spark, path)


@query("s7_mixed_layout", r"""WITH l AS (SELECT regexp_split_to_array(trim(line), '\s+') AS p FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT split_part(CASE WHEN contains(p[1], '_') THEN p[2] ELSE p[1] END, '-', 1) AS id, CASE WHEN contains(p[1], '_') THEN p[3] ELSE p[2] END AS location,
CASE WHEN contains(p[1], '_') THEN p[4] ELSE p[3] END AS type FROM l WHERE contains(p[1], '_') OR regexp_matches(p[1], '^[A-Za-z]')""")
def s7(spark, d):
    return T.mixed_layout(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@query("s8_matrix_to_long", "SELECT 'm' || label::VARCHAR AS row, 'p' || (i - 1)::VARCHAR AS column, round(avg(embedding[i]), 5) AS value FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def s8(spark, d):
    path = _folder(spark, "matrix")
    means = table(spark, d, "embeddings").groupBy("label").agg(*[F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 5).alias(f"p{i}") for i in range(64)])
    line = F.concat_ws(",", F.concat(F.lit("m"), "label"), *[f"p{i}" for i in range(64)])
    # one file per label, each with its header
    means.select("label", F.concat(F.lit("aa," + ",".join(f"p{i}" for i in range(64)) + "\n"), line).alias("value")).repartition("label").write.partitionBy("label").text(path)
    return T.matrix_to_long(spark, f"{path}/*/*.txt").drop("file")


@query("s9_region_tensor", "SELECT label AS region_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS pos, embedding AS f FROM embeddings")
def s9(spark, d):
    return T.region_tensor(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("s10_write_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def s10(spark, d):
    path = _folder(spark, "orders")
    T.write_table(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path)


@query("p1_parse_region_key", "SELECT split_part(c_name, '#', 1) AS id, split_part(c_name, '#', 2)::INT AS start FROM customer")
def p1(spark, d):
    i, start, _ = S.parse_region_key(F.col("c_name"), "#")
    return table(spark, d, "customer").select(i.alias("id"), start.alias("start"))


@query("p2_region_length", "SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey + 1 AS len FROM lineitem")
def p2(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.region_length(F.col("l_suppkey"), F.col("l_partkey")).alias("len"))


@query("p3_parse_mutation", r"""SELECT p_partkey, nullif(regexp_extract(x, '([A-Z])(\d+)([A-Z])', 1), '') AS orig, try_cast(regexp_extract(x, '([A-Z])(\d+)([A-Z])', 2) AS INT) AS pos, nullif(regexp_extract(x, '([A-Z])(\d+)([A-Z])', 3), '') AS changed
FROM (SELECT p_partkey, substr(p_type, 1, 1) || p_size::VARCHAR || CASE WHEN p_size % 3 = 0 THEN 'x' ELSE substr(p_brand, 1, 1) END AS x FROM part)""")
def p3(spark, d):
    x = F.concat(F.substring("p_type", 1, 1), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "x").otherwise(F.substring("p_brand", 1, 1)))
    o, p, c = S.parse_mutation(x)
    return table(spark, d, "part").select("p_partkey", o.alias("orig"), p.alias("pos"), c.alias("changed"))


@query("p4_parse_variant_suffix", r"SELECT p_partkey, try_cast(regexp_extract(p_brand, '(\d+)', 1) AS INT) AS pos, nullif(regexp_extract(p_type, '([A-Z])$', 1), '') AS changed FROM part")
def p4(spark, d):
    return table(spark, d, "part").select("p_partkey", S.parse_variant_suffix(F.col("p_brand"))[0].alias("pos"), S.parse_variant_suffix(F.col("p_type"))[1].alias("changed"))


@query("p5_parse_mutation_id", "SELECT n_name AS region, 'A' AS orig, n_nationkey AS pos, 'C' AS changed, n_nationkey - 1 AS idx FROM nation")
def p5(spark, d):
    r, o, p, c = S.parse_mutation_id(F.concat("n_name", F.lit("_A:"), "n_nationkey", F.lit(":C")))
    return table(spark, d, "nation").select(r.alias("region"), o.alias("orig"), p.alias("pos"), c.alias("changed"), (p - 1).alias("idx"))


@query("p6_first_field", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, substr(o_orderpriority, 2) AS rest FROM orders")
def p6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.first_field(F.col("o_orderpriority"), "-").alias("level"), S.strip_first(F.col("o_orderpriority")).alias("rest"))


@query("p7_unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, variable, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value)")
def p7(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"], "variable", "value").where("value is not null")


_NULLS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)"


def _nulls(spark, d):
    keep = F.col("o_orderkey") % 7 != 0
    return table(spark, d, "orders").select("o_orderkey", F.when(keep, F.col("o_orderstatus")).alias("status"), F.when(keep, F.col("o_totalprice")).alias("price"))


@query("p8_null_safe_ne", f"SELECT * FROM {_NULLS} WHERE status IS DISTINCT FROM 'F'")
def p8(spark, d):
    return _nulls(spark, d).where(S.null_safe_ne(F.col("status"), "F"))


@query("p9_filter_not_contains", "SELECT doc_id FROM documents WHERE NOT contains(text, ':')")
def p9(spark, d):
    return table(spark, d, "documents").where(~F.contains(F.col("text"), F.lit(":"))).select("doc_id")


@query("p10_drop_start", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 1 AND l_returnflag <> 'R'")
def p10(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber <> 1 and l_returnflag <> 'R'").select("l_orderkey", "l_linenumber")


@query("p11_dropna", f"SELECT * FROM {_NULLS} WHERE status IS NOT NULL AND price IS NOT NULL")
def p11(spark, d):
    return _nulls(spark, d).na.drop(subset=["status", "price"])


@query("p12_coerce_numeric", """SELECT event_id, try_cast(regexp_extract(props, '"k": (.)', 1) AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events""")
def p12(spark, d):
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", '"k": (.)', 1).try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("p13_select_by_pattern", "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem")
def p13(spark, d):
    return S.select_by_pattern(table(spark, d, "lineitem"), ["^l_order", "^l_line"])


@query("p14_drop_by_pattern", "SELECT c_custkey, c_name FROM customer")
def p14(spark, d):
    return S.select_by_pattern(table(spark, d, "customer"), ["nation", "acctbal", "segment"], drop=True)


@query("p15_label_binary", "SELECT doc_id, CASE WHEN quality = 1 THEN 'Pathogenic' ELSE 'Benign' END AS outcome FROM labels")
def p15(spark, d):
    return table(spark, d, "labels").select("doc_id", S.label_binary(F.col("quality")).alias("outcome"))


@query("p16_case_select", f"SELECT o_orderkey, CASE WHEN status = 'F' AND price < 100000 THEN 'F short' WHEN status = 'F' THEN 'F long' WHEN price < 100000 THEN 'other short' END AS category FROM {_NULLS}")
def p16(spark, d):
    f, short = F.col("status") == "F", F.col("price") < 100000
    return _nulls(spark, d).select("o_orderkey", S.case_select([(f & short, "F short"), (f, "F long"), (short, "other short")]).alias("category"))


@query("p17_pair_class", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A','R') THEN 'In' ELSE 'Out' END || ' --> ' || CASE WHEN l_linestatus IN ('A','R','O') THEN 'In' ELSE 'Out' END AS change FROM lineitem".replace("('A','R','O')", "('A','R')"))
def p17(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.pair_class(F.col("l_returnflag"), F.col("l_linestatus"), ["A", "R"]).alias("change"))


@query("p18_charge_class", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('R','K','H') THEN 'Positive' WHEN l_returnflag IN ('D','E','A') THEN 'Negative' ELSE 'Uncharged' END AS charge FROM lineitem")
def p18(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.charge_class(F.col("l_returnflag"), negative=("D", "E", "A")).alias("charge"))


@query("p19_apply_substitution", "SELECT p_partkey, substr(p_name, 1, 1) || 'X' || substr(p_name, 3) AS seq FROM part")
def p19(spark, d):
    return table(spark, d, "part").select("p_partkey", S.apply_substitution(F.col("p_name"), F.lit(2), F.lit("X")).alias("seq"))


@query("p20_rename_map", "SELECT doc_id, CASE WHEN toxic = 0 THEN 1 WHEN toxic = 1 THEN 0 END AS outcome FROM labels")
def p20(spark, d):
    return table(spark, d, "labels").select("doc_id", S.rename_values(F.col("toxic"), {0: 1, 1: 0}).alias("outcome"))


@query("p21_make_key", "SELECT r_name || '_' || n_name || ':' || n_nationkey::VARCHAR AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def p21(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws(":", F.concat_ws("_", "r_name", "n_name"), "n_nationkey").alias("key"))


@query("p22_fillna_flag", f"SELECT o_orderkey, coalesce(status, 'None') AS status, CASE WHEN status IS NULL THEN 'No' ELSE 'Yes' END AS known FROM {_NULLS}")
def p22(spark, d):
    return _nulls(spark, d).select("o_orderkey", F.coalesce("status", F.lit("None")).alias("status"), F.when(F.col("status").isNull(), "No").otherwise("Yes").alias("known"))


@query("p23_exclude_keys", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view') OR event_type IS NULL")
def p23(spark, d):
    return table(spark, d, "events").where(~F.coalesce(F.col("event_type").isin("error", "view"), F.lit(False))).select("event_id")


@query("p24_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.04 AND l_quantity >= 20 AND l_returnflag = 'A'")
def p24(spark, d):
    return table(spark, d, "lineitem").where((F.col("l_discount") < 0.04) & (F.col("l_quantity") >= 20) & (F.col("l_returnflag") == "A")).select("l_orderkey", "l_linenumber")


@query("p25_drop_rename", "SELECT o_orderkey AS order_id, o_totalprice AS score FROM orders")
def p25(spark, d):
    return table(spark, d, "orders").drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").withColumnsRenamed({"o_orderkey": "order_id", "o_totalprice": "score"})


@query("p26_cast", "SELECT l_orderkey, l_linenumber, l_quantity::INT AS quantity, try_cast(l_returnflag AS INT) AS flag FROM lineitem")
def p26(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").try_cast("int").alias("flag"))


@query("l1_top_n", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def l1(spark, d):
    return L.top_n(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 10, "s_suppkey")


@query("l2_sort_by", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n")
def l2(spark, d):
    return L.sort_by(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "n")


@query("l3_seeded_shuffle")
def l3(spark, d):
    return L.seeded_shuffle(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42, 800)


@query("l4_batch_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def l4(spark, d):
    return L.batch_slice(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 41, 20).select("o_orderkey")


@query("l4_batch_slice_far", "SELECT l_id FROM (SELECT DISTINCT l_orderkey * 1000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS l_id FROM lineitem) ORDER BY l_id DESC LIMIT 20 OFFSET 5")
def l4_far(spark, d):
    """A slice near the end of a long list, whose length is counted first."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("l_id")).distinct()
    return L.batch_slice(rows, "l_id", rows.count() - 24, 20).select("l_id")


@query("l4_numbered", "SELECT l_id, row_number() OVER (ORDER BY l_id) AS row_no FROM (SELECT l_orderkey * 1000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS l_id FROM lineitem GROUP BY 1)")
def l4_numbered(spark, d):
    return L.numbered(table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("l_id")).distinct(), "l_id")


@query("l5_burn_in_sample")
def l5(spark, d):
    return L.burn_in_sample(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 0.02, 20, 7)


@query("u1_union_by_name", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END AS tag FROM orders")
def u1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return L.union_by_name(o.where("o_orderkey % 2 = 0").withColumn("tag", F.lit("even")), o.where("o_orderkey % 2 = 1"))


@query("u2_complement", f"SELECT * FROM {_NULLS} WHERE NOT coalesce(status = 'F' AND price > 200000, false) AND NOT coalesce(status = 'O', false)")
def u2(spark, d):
    return L.complement(_nulls(spark, d), (F.col("status") == "F") & (F.col("price") > 200000), F.col("status") == "O")


@query("u3_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def u3(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()


@query("f1_split_explode_zipped", "SELECT doc_id, unnest(string_split(lang || ';' || source, ';')) AS a, unnest(string_split(source || ';' || lang, ';')) AS b FROM documents")
def f1(spark, d):
    lists = table(spark, d, "documents").select("doc_id", F.concat_ws(";", "lang", "source").alias("a"), F.concat_ws(";", "source", "lang").alias("b"))
    return S.split_explode_zipped(lists, ["a", "b"])


@query("f2_split_explode_ranges", r"""SELECT l_orderkey, l_linenumber, split_part(r, '-', 1)::INT AS start, try_cast(split_part(r, '-', 2) AS INT) AS "end"
FROM (SELECT l_orderkey, l_linenumber, unnest(regexp_split_to_array(l_suppkey::VARCHAR || '-' || l_partkey::VARCHAR || ',x-3+' || l_linenumber::VARCHAR || '-9', '[,+]')) AS r FROM lineitem) WHERE regexp_matches(split_part(r, '-', 1), '^\d+$')""")
def f2(spark, d):
    text = F.concat("l_suppkey", F.lit("-"), "l_partkey", F.lit(",x-3+"), "l_linenumber", F.lit("-9"))
    return S.split_explode_ranges(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("r")), "r").drop("r")


@query("f4_one_hot_diff", "SELECT l_orderkey, l_linenumber, list_transform(['A','F','N','O','R'], lambda a: (l_linestatus = a)::INT - (l_returnflag = a)::INT) AS v FROM lineitem")
def f4(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.one_hot_diff(F.col("l_linestatus"), F.col("l_returnflag"), list("AFNOR")).alias("v"))


@query("f5_property_diff", "SELECT a.vec_id, list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("n")), "vec_id").select("vec_id", S.vector_diff(F.col("e"), F.col("n")).alias("v"))


_SEQ = "(SELECT doc_id, lang AS protein, regexp_replace(lower(text), '[^a-z]', '', 'g') AS seq FROM documents)"


def _seq(spark, d):
    """The letters of each text."""
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("protein"), F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("seq"))


def _pieces(spark, d, size):
    """Each text's letters in consecutive pieces (w from 0) of ``size``; the last one may be shorter."""
    parts = F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0))
    return _seq(spark, d).select("doc_id", "protein", F.posexplode(parts).alias("w", "seq"))


def _pieces_sql(size):
    return f"(SELECT doc_id, protein, unnest(range(len(x)))::INT AS w, unnest(x) AS seq FROM (SELECT doc_id, protein, regexp_extract_all(seq, '.{{1,{size}}}') AS x FROM {_SEQ}))"


def _n(x, letters):
    return f"(length({x}) - length(translate({x}, '{letters}', '')))::DOUBLE"


def _sigma(x):
    p, n = _n(x, "aeiou"), _n(x, "strn")
    return f"coalesce(({p} - {n}) * ({p} - {n}) / nullif({p} + {n}, 0), 0.0)"


@query("f6_charge_sigma", f"SELECT doc_id, round({_sigma('seq')}, 6) AS sigma FROM {_SEQ}")
def f6(spark, d):
    return _seq(spark, d).select("doc_id", F.round(S.charge_sigma(F.col("seq"), "aeiou", "strn"), 6).alias("sigma"))


@query("f7_charge_gamma", f"SELECT doc_id, w, round(list_sum(list_transform(range(10), lambda k: pow({_sigma('substr(seq, (k * 2 + 1)::BIGINT, 5)')} - {_sigma('seq')}, 2))) / 10, 6) AS gamma FROM {_pieces_sql(18)}")
def f7(spark, d):
    return _pieces(spark, d, 18).select("doc_id", "w", F.round(S.charge_gamma(F.col("seq"), 18, "aeiou", "strn"), 6).alias("gamma"))


@query("f8_cluster_counts", f"SELECT doc_id, [(length(seq) - length(translate(seq, 'aeiou', '')))::INT, (length(seq) - length(translate(seq, 'strn', '')))::INT] AS v FROM {_SEQ}")
def f8(spark, d):
    return _seq(spark, d).select("doc_id", S.cluster_counts(F.col("seq"), ["aeiou", "strn"]).alias("v"))


@query("f9_residue_counts", f"SELECT protein, pos, letter, count(*) AS n FROM (SELECT protein, unnest(range(length(seq)))::INT AS pos, unnest(string_split(seq, '')) AS letter FROM {_SEQ} WHERE length(seq) > 0) GROUP BY ALL")
def f9(spark, d):
    return A.letter_counts(_seq(spark, d), "protein", "seq")


@query("f10_transforms", "SELECT l_orderkey, l_linenumber, round(asin(sqrt(l_discount)), 9) AS a, round(log10(l_tax + 0.0001), 9) AS b FROM lineitem")
def f10(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.arcsin_sqrt(F.col("l_discount")), 9).alias("a"), F.round(S.log10_shift(F.col("l_tax")), 9).alias("b"))


@query("f12_significance_stars", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.001 THEN '***' WHEN l_discount <= 0.01 THEN '**' WHEN l_discount <= 0.05 THEN '*' ELSE 'ns' END AS stars FROM lineitem")
def f12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.significance_stars(F.col("l_discount")).alias("stars"))


@query("f13_feature_names", "SELECT vec_id, embedding[1] AS Res_1, embedding[2] AS Res_2, embedding[3] AS Res_3 FROM embeddings")
def f13(spark, d):
    return S.explode_feature_names(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 3, "Res")


_HEAD, _TAIL = "substr(seq, 1, 9) || substr(seq, 11, 9)", "substr(seq, length(seq) - 18, 9) || substr(seq, length(seq) - 8, 9)"


@query("w5_context_window", f"SELECT doc_id, w, CASE WHEN length(seq) >= 19 THEN CASE WHEN 32 >= length(seq) - 9 THEN {_TAIL} ELSE substr(seq, 24, 9) || substr(seq, 34, 9) END END AS middle, CASE WHEN length(seq) >= 19 THEN {_HEAD} END AS head, CASE WHEN length(seq) >= 19 THEN {_TAIL} END AS tail FROM {_pieces_sql(64)}")
def w5(spark, d):
    s, n = F.col("seq"), F.length("seq")
    return _pieces(spark, d, 64).select("doc_id", "w", S.context_window(s, F.lit(32), 19).alias("middle"), S.context_window(s, F.lit(3), 19).alias("head"), S.context_window(s, n - 2, 19).alias("tail"))


@query("w6_segment_windows", f"SELECT doc_id, w, list_transform(range(10), lambda k: substr(seq, (k * 2 + 1)::BIGINT, 5)) AS parts FROM {_pieces_sql(18)}")
def w6(spark, d):
    return _pieces(spark, d, 18).select("doc_id", "w", S.segment_windows(F.col("seq"), 18).alias("parts"))
