"""Registered queries of the catalogue operators over the driver's tables, each with its SQL.

The driver has no catalogue and no vocabulary; both are derived from its tables, in the same SQL for Spark and the
oracle: a catalogue's columns are the rows of part (a table for each brand), its terms are the rows of embeddings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmeta.functions import predicates, text, vectors
from colmeta.operators import answers, inverted, linking, match, merge, profile, select
from colmeta.plans import pipelines
from colmeta.sources import context, export, lake, metadata, store, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- derived tables, in SQL that both engines take --

CATALOGUE = """
select p_brand as table_id, cast(p_partkey as int) as ordinal, concat('col_', p_partkey) as name,
  case p_size % 3 when 0 then 'numeric' when 1 then 'date' else 'text' end as datatype,
  case when p_partkey % 4 = 0 then '' else p_type end as element,
  case when p_partkey % 5 = 0 then null else concat('u', p_size) end as unit, '' as method,
  case when p_partkey % 2 = 0 then '' else p_name end as description,
  case when p_partkey % 6 = 1 then concat('http://vocab.example/', p_partkey) end as uri
from {part}"""
IMPORT = """
select p_brand as table_id, concat(case when p_partkey % 9 = 0 then 'zzz_' else 'col_' end, p_partkey) as name, p_partkey * 2 as seq,
  case when p_partkey % 7 = 0 then '' else concat('new ', p_type) end as element,
  case when p_partkey % 11 = 0 then null else concat('v', p_size) end as unit,
  case when p_partkey % 3 = 0 then ' ' else '' end as description
from {part}
union all
select p_brand, concat('col_', p_partkey), p_partkey * 2 + 1, '', case when p_partkey % 10 = 0 then concat('w', p_size) end, case when p_partkey % 8 = 0 then 'again' end
from {part}"""
TERMS = """
select vec_id as id, concat('http://vocab.example/', label, '/', vec_id % 3) as uri, concat('term_', vec_id) as label,
  concat('definition of ', vec_id) as definition, case when vec_id % 2 = 0 then 'prefLabel' else 'altLabel' end as qc_label, embedding as vector
from {embeddings}"""
SHEETS = """
select 'book' as file, concat('nation_', c_nationkey) as sheet, 0 as row, 0 as col, 'Customers of one nation' as value from {customer} where c_nationkey % 2 = 0 group by c_nationkey
union all
select 'book', concat('nation_', c_nationkey), case when c_nationkey % 2 = 0 then 1 else 0 end, c, case c when 0 then ' key' when 1 then 'name' when 2 then '' else 'balance ' end
from (select distinct c_nationkey from {customer}) n cross join (select 0 as c union all select 1 union all select 2 union all select 3) k
union all
select 'book', concat('nation_', c_nationkey), cast(case when c_nationkey % 2 = 0 then 1 else 0 end + row_number() over (partition by c_nationkey, c order by c_custkey) as int), c,
  case c when 0 then cast(c_custkey as {string}) when 1 then c_name when 2 then c_mktsegment else cast(cast(floor(c_acctbal) as bigint) as {string}) end
from {customer} cross join (select 0 as c union all select 1 union all select 2 union all select 3) k"""
LINES = """
select p_brand as file, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as bigint) as line_no,
  case p_brand_no % 5
    when 0 then concat(p_name, ',"', p_type, ';x",', p_size)
    when 1 then concat(p_name, ';', p_type, ';', p_size, ';"a,b"')
    when 2 then concat(p_name, '|', p_type, '|1,5|', p_size)
    when 3 then concat(p_name, chr(9), p_type, chr(9), p_size)
    else p_name end as value
from (select *, cast(right(p_brand, 1) as int) as p_brand_no from {part}) p"""


def _oracle(sql: str) -> str:
    names = ("part", "embeddings", "customer")
    return sql.format(**{n: n for n in names}, string="varchar") if "{" in sql else sql


def _derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [n for n in ("part", "embeddings", "customer") if f"{{{n}}}" in sql]
    return spark.sql(sql.replace("{string}", "string"), **{n: _table(spark, sf_dir, n) for n in used})


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _derived(spark, sf_dir, CATALOGUE)
    uris = F.when(F.col("uri").isNotNull() & (F.col("element") != ""), F.create_map("element", "uri"))
    return df.withColumn("element_uri", uris).drop("uri")


CAT = f"cat as (select * exclude (uri), case when uri is not null and element <> '' then concat('{{\"', element, '\":\"', uri, '\"}}') else '' end as element_uri from ({_oracle(CATALOGUE)}) c)"
IMP = f"imp as ({_oracle(IMPORT)})"
VOC = f"voc as ({_oracle(TERMS)})"
META = "table_id, ordinal, name, datatype, element, unit, method, description, element_uri"

# -- profiles --

_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%m.%d.%Y", "%d.%m.%Y", "%d-%b-%Y", "%Y-%m", "%m-%Y", "%Y/%m", "%m/%Y", "%b-%Y", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f")
_NUM = "(try_cast(replace(v, ',', '.') as double) is not null)"
_DATE = f"(coalesce({', '.join(f'''try_strptime(v, '{f}')''' for f in _FORMATS)}) is not null)"
_COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "nation": "n_nationkey n_name n_regionkey",
    "region": "r_regionkey r_name",
}


def _profile_sql(table: str, table_id: str | None = None, columns: list[str] | None = None, value: str = "cast({} as varchar)", sample: str | None = None) -> str:
    parts = []
    for i, c in enumerate(columns or _COLUMNS[table].split()):
        source = f"select {value.format(c)} as v from {table}"
        if sample:
            source = f"select v from (select {value.format(c)} as v, row_number() over (order by {sample}) as rn from {table} where {c} is not null) where rn <= 200"
        parts.append(
            f"select '{table_id or table}' as table_id, {i} as ordinal, '{c}' as name, count(*) filter (v <> '') as n_values, count(*) filter ({_NUM}) as n_numeric, count(*) filter (not {_NUM} and {_DATE}) as n_date"
            f" from (select regexp_replace(v, '^\\s+|\\s+$', '', 'g') as v from ({source}))"
        )
    return f"select *, case when n_values > 0 and n_numeric >= 0.8 * n_values then 'numeric' when n_values > 0 and n_date >= 0.8 * n_values then 'date' else 'string' end as datatype from ({' union all '.join(parts)})"


@_query(_profile_sql("orders"))
def type_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(_table(spark, sf_dir, "orders"), "orders")


@_query(_profile_sql("customer", columns=_COLUMNS["customer"].split()[1:], sample="c_custkey"))
def type_profile_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_cells(profile.cells(_table(spark, sf_dir, "customer"), "customer", "c_custkey"), 200)


@_query(_profile_sql("lineitem", value="replace(cast({} as varchar), '.', ',')"))
def type_profile_comma_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    return profile.profile(df.select(*(F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in df.columns)), "lineitem")


_MANY = ("region", "nation", "part", "supplier", "customer")


@_query(" union all ".join(f"({_profile_sql(t)})" for t in _MANY))
def type_profile_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in _MANY:
        one = profile.profile(_table(spark, sf_dir, t), t)
        out = one if out is None else out.unionByName(one)
    return out


@_query(ORACLE["type_profile_catalogue"])
def type_profile_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables as files of a lake, in one plan."""
    return lake.profile_files(lake.table_files(spark, {t: f"{sf_dir}/{t}.parquet" for t in _MANY}))


@_query(f"select table_id, ordinal, name, datatype, '' as element, '' as unit, '' as method, '' as description, '' as element_uri from ({_profile_sql('supplier')})")
def metadata_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_csv_rows(pipelines.table_metadata(_table(spark, sf_dir, "supplier"), "supplier"))


# -- linked tables --


@_query("select * from lineitem left join orders on l_orderkey = o_orderkey")
def linked_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.linked(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey")


@_query("""select o.event_id, o.site, o.value as value_obs, s.value as value_site
from (select event_id, nullif(user_id % 40, 0) as site, value from events) o
left join (select nullif(n_nationkey, 0) as site, n_name as value from nation) s on o.site is not distinct from s.site""")
def linked_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("user_id") % 40, F.lit(0)).alias("site"), "value")
    sites = _table(spark, sf_dir, "nation").select(F.nullif("n_nationkey", F.lit(0)).alias("site"), F.col("n_name").alias("value"))
    return linking.linked(seen, sites, "site", "site")


_LINKED = "(select * from orders left join customer on o_custkey = c_custkey)"


@_query(_profile_sql(_LINKED, "linked", f"{_COLUMNS['orders']} {_COLUMNS['customer']}".split()))
def linked_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = linking.linked(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")
    return profile.profile(both, "linked")


@_query("select * from orders order by o_orderkey limit 5")
def preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(5)


# -- sheets and delimited text --

_HEADER = """, width as (select file, sheet, max(col) + 1 as width from cells group by 1, 2),
found as (select file, sheet, min(row) as header_row from (select c.file, c.sheet, c.row, count(*) filter (trim(value) <> '') as filled, max(width) as width from cells c join width using (file, sheet) where c.row < 10 group by 1, 2, 3) where filled > 0 and 2 * filled >= width group by 1, 2),
head as (select w.file, w.sheet, coalesce(header_row, 0) as header_row from width w left join found using (file, sheet))"""


@_query(f"with cells as ({_oracle(SHEETS)}){_HEADER} select * from head")
def header_row_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_rows(_derived(spark, sf_dir, SHEETS))


@_query(
    f"with cells as ({_oracle(SHEETS)}){_HEADER}, names as (select file, sheet, col, nullif(trim(value), '') as header from cells join head using (file, sheet) where row = header_row) "
    "select c.file, c.sheet, c.row - header_row - 1 as row_id, c.col as ordinal, coalesce(header, concat('col_', c.col)) as name, value from cells c join head using (file, sheet) left join names n on n.file = c.file and n.sheet = c.sheet and n.col = c.col where c.row > header_row"
)
def header_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_header(_derived(spark, sf_dir, SHEETS))


@_query(
    f"""with lines as ({_oracle(LINES)}), bare as (select file, regexp_replace(value, '"[^"]*"', '', 'g') as b from lines where trim(value) <> ''),
each_ as (select file, rank, d, length(b) - length(replace(b, d, '')) as n from bare cross join (select 0 as rank, ',' as d union all select 1, ';' union all select 2, chr(9) union all select 3, '|')),
best as (select file, d, row_number() over (partition by file order by count(*) desc, n desc, rank) as place from each_ where n > 0 group by file, rank, d, n)
select l.file, coalesce(d, ',') as delimiter, d is not null as found from (select distinct file from lines) l left join (select * from best where place = 1) b using (file)"""
)
def delimiter_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sniffed(_derived(spark, sf_dir, LINES))


_NA_CASE = "case event_id % 6 when 0 then 'NA' when 1 then '' when 2 then 'n/a' when 3 then 'None' when 4 then ' NA' else event_type end"


@_query(f"select event_id, case when v not in ({', '.join(repr(t) for t in predicates.NA_TOKENS)}) then v end as v, event_type from (select event_id, {_NA_CASE} as v, event_type from events)")
def na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cleaned(_table(spark, sf_dir, "events").select("event_id", F.expr(_NA_CASE).alias("v"), "event_type"))


# -- merging metadata --


def _merge(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return export.to_csv_rows(merge.merged(_catalogue(spark, sf_dir), _derived(spark, sf_dir, IMPORT), mode))

    return run


_LAST = """last as (select table_id, name, max_by(element, seq) filter (coalesce(element, '') <> '') as e, max_by(unit, seq) filter (coalesce(unit, '') <> '') as u, max_by(description, seq) filter (coalesce(description, '') <> '') as d from imp group by 1, 2)"""
_YES = f"select c.table_id, ordinal, c.name, datatype, coalesce(e, element) as element, coalesce(u, unit) as unit, method, coalesce(d, description) as description, element_uri from cat c left join last using (table_id, name)"
_FILL = "select c.table_id, ordinal, c.name, datatype, case when coalesce(element, '') = '' and e is not null then e else element end as element, case when coalesce(unit, '') = '' and u is not null then u else unit end as unit, method, case when coalesce(description, '') = '' and d is not null then d else description end as description, element_uri from cat c left join last using (table_id, name)"
_ALL = "select c.table_id, ordinal, c.name, datatype, case when i.name is null then c.element else i.element end as element, case when i.name is null then c.unit else i.unit end as unit, method, case when i.name is null then c.description else i.description end as description, element_uri from cat c left join (select * from imp qualify row_number() over (partition by table_id, name order by seq desc) = 1) i on i.table_id = c.table_id and i.name = c.name"

for _name, _mode, _sql in (
    ("merge_overwrite", "yes", f"with {CAT}, {IMP}, {_LAST} {_YES}"),
    ("merge_fill_blanks", "fill_blanks", f"with {CAT}, {IMP}, {_LAST} {_FILL}"),
    ("merge_incl_blanks", "yes_incl_blanks", f"with {CAT}, {IMP} {_ALL}"),
    ("merge_no_overwrite", "no_overwrite", f"with {CAT} select {META} from cat"),
):
    QUERIES[_name], ORACLE[_name] = _merge(_mode), _sql


@_query(f"with {CAT} select {META.replace('datatype', '''case when datatype in ('string', 'numeric', 'date') then datatype else 'string' end as datatype''')} from cat")
def datatype_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_csv_rows(profile.validated(_catalogue(spark, sf_dir)))


@_query(
    f"with {CAT}, {IMP}, {_LAST}, new as ({_YES}) select c.table_id, c.ordinal, 'changed' as change, concat_ws(',', case when c.element is distinct from n.element then 'element' end, case when c.unit is distinct from n.unit then 'unit' end, case when c.description is distinct from n.description then 'description' end) as fields "
    "from cat c join new n using (table_id, ordinal) where c.element is distinct from n.element or c.unit is distinct from n.unit or c.description is distinct from n.description"
)
def metadata_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _catalogue(spark, sf_dir)
    found = merge.difference(old, merge.merged(old, _derived(spark, sf_dir, IMPORT), "yes"))
    return found.withColumn("fields", F.array_join("fields", ","))


# -- vectors --


@_query("select vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) as length, round(u[1], 6) as first from (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 3) as v from embeddings))")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    df = _table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(v).alias("u"))
    return df.select("vec_id", F.round(vectors.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"))


@_query("select a.vec_id, b.vec_id is not null as has_definition, round(case when b.vec_id is null then a.embedding[1]::double else 0.4 * a.embedding[1]::double + 0.6 * b.embedding[1]::double end, 6) as first, round(case when b.vec_id is null then a.embedding[64]::double else 0.4 * a.embedding[64]::double + 0.6 * b.embedding[64]::double end, 6) as last from embeddings a left join embeddings b on b.vec_id = a.vec_id * 2")
def vector_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    other = df.select((F.col("vec_id") / 2).alias("half"), F.col("embedding").alias("definition"))
    both = df.join(other, df["vec_id"].cast("double") == other["half"], "left").withColumn("mix", vectors.blended(F.col("embedding"), F.col("definition")))
    return both.select("vec_id", F.col("definition").isNotNull().alias("has_definition"), F.round(F.col("mix")[0], 6).alias("first"), F.round(F.col("mix")[63], 6).alias("last"))


@_query("select label, pos, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by label, pos")
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.mean_vectors(_table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("pos", "mean")).select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, TERMS)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _nearest_sql(d: str = "list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))") -> str:
    return f"near as (select query, id, distance, cast(row_number() over (partition by query order by distance, id) as int) as rank from (select q.vec_id as query, t.vec_id as id, {d} as distance from embeddings q join embeddings t on q.vec_id <> t.vec_id where q.vec_id % 100 = 0) qualify rank <= 4)"


_NEAR = f"with {_nearest_sql()} select query, id, round(distance, 6) as distance, rank from near"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@_query(_NEAR)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.nearest_by_expression(_asked(spark, sf_dir), _terms(spark, sf_dir), exclude_same_id=True))


@_query(_NEAR)
def knn_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.nearest(_asked(spark, sf_dir), _terms(spark, sf_dir), exclude_same_id=True))


@_query(f"with {_nearest_sql('1 - list_cosine_similarity(q.embedding::double[], t.embedding::double[])')} select query, id, round(distance, 6) as distance, rank from near")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.nearest_by_expression(_asked(spark, sf_dir), _terms(spark, sf_dir), metric="cosine", exclude_same_id=True))


@_query()
def knn_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(inverted.near_by_lists(_asked(spark, sf_dir), inverted.inverted_file(_terms(spark, sf_dir)), exclude_same_id=True))


# -- matches --

HITS = f"{_nearest_sql()}, {VOC}, hits as (select query, n.id, distance, rank, uri, label, definition as term_definition, qc_label from near n join voc using (id))"
KEPT = f"{HITS}, kept as (select *, concat('col_', query) as header, cast(query as int) as ordinal from hits qualify row_number() over (partition by query, uri order by case qc_label when 'prefLabel' then 0 when 'altLabel' then 1 else 2 end, distance, id) = 1), best as (select *, row_number() over (partition by header order by distance, id) = 1 as selected from kept)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.with_terms(match.nearest(_asked(spark, sf_dir), _terms(spark, sf_dir), exclude_same_id=True), _terms(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = match.preferred(_hits(spark, sf_dir))
    return kept.withColumns({"header": F.concat(F.lit("col_"), F.col("query").cast("string")), "ordinal": F.col("query").cast("int")})


@_query(f"with {HITS} select query, id, round(distance, 6) as distance, rank, uri, label, term_definition, qc_label from hits")
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_hits(spark, sf_dir))


@_query(f"with {KEPT} select query, id, round(distance, 6) as distance, rank, uri, label, qc_label from kept")
def uri_dedup_pref_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.preferred(_hits(spark, sf_dir))).drop("term_definition")


@_query(f"with {KEPT} select header, id, round(distance, 6) as distance, selected from best")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(select.best_selected(_kept(spark, sf_dir))).select("header", "id", "distance", "selected")


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the vectors' columns, one table."""
    df = _table(spark, sf_dir, "embeddings")
    blank = F.lit("")
    name = F.concat(F.lit("col_"), F.col("vec_id").cast("string"))
    return df.select(F.lit("vectors").alias("table_id"), F.col("vec_id").cast("int").alias("ordinal"), name.alias("name"), F.lit("numeric").alias("datatype"), F.lit("old").alias("element"), blank.alias("unit"), blank.alias("method"), F.concat(F.lit("column of label "), F.col("label").cast("string")).alias("description"), F.lit(None).cast("map<string,string>").alias("element_uri"))


_OWN = "own as (select 'vectors' as table_id, cast(vec_id as int) as ordinal, concat('col_', vec_id) as name, 'numeric' as datatype, 'old' as element, '' as unit, '' as method, concat('column of label ', label) as description from embeddings)"


@_query(f"with {KEPT}, {_OWN} select b.header, b.id, b.label, description as header_description from best b left join own on name = header")
def match_with_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _kept(spark, sf_dir).withColumn("table_id", F.lit("vectors"))
    return select.with_description(hits, _own(spark, sf_dir)).select("header", "id", "label", "header_description")


@_query("""select case when group_id % 2 = 0 then '🔶' else '🔷' end as marker, event_id, user_id, kind, group_id from (select event_id, user_id, kind, cast(sum(case when first or kind is distinct from before then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as int) as group_id
from (select event_id, user_id, ts, kind, lag(kind) over w as before, row_number() over w = 1 as first from (select *, nullif(event_type, 'view') as kind from events) window w as (partition by user_id order by ts, event_id)))""")
def change_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.nullif("event_type", F.lit("view")).alias("kind"))
    return select.change_groups(df, "kind", ["user_id"], ["ts", "event_id"]).drop("ts")


@_query("""select case when group_id % 2 = 0 then '🔶' else '🔷' end as marker, event_id, kind, group_id from (select event_id, kind, cast(sum(case when first or kind is distinct from before then 1 else 0 end) over (order by ts, event_id rows unbounded preceding) as int) as group_id
from (select event_id, ts, kind, lag(kind) over w as before, row_number() over w = 1 as first from (select *, nullif(event_type, 'view') as kind from events) window w as (order by ts, event_id)))""")
def change_groups_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one table, cut into ranges of its order."""
    df = _table(spark, sf_dir, "events").select(F.lit("events").alias("table_id"), "event_id", "ts", F.nullif("event_type", F.lit("view")).alias("kind"))
    return select.change_groups_across(df, "kind", ["table_id"], ["ts", "event_id"]).drop("table_id", "ts")


_SUM = ", one as (select header, label, min(uri) as least, min(ordinal) as ordinal from best where pick group by 1, 2), summed as (select header, string_agg(label, ' || ' order by label) as vocab, min(ordinal) as first_at, concat('{', string_agg(concat('\"', label, '\":\"', least, '\"'), ',' order by label), '}') as element_uri from one group by 1)"
def _sum_sql(pick: str) -> str:
    return f"{KEPT}{_SUM}".replace("where pick", f"where {pick}")


_EVEN = "id % 2 = 0"


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of which the terms with even ids are selected."""
    return _kept(spark, sf_dir).withColumn("selected", F.expr(_EVEN))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("header", F.array_join("vocab", " || ").alias("vocab"), F.to_json("element_uri").alias("element_uri"), "first_at")


@_query(f"with {_sum_sql(_EVEN)} select header, vocab, element_uri, first_at from summed")
def term_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(select.summary(_picked(spark, sf_dir)))


_UNMATCHED = "full_ as (select header, vocab, element_uri, first_at from summed union all select header, '', '{}', min(ordinal) from best b where not exists (select 1 from summed s where s.header = b.header) group by header)"


@_query(f"with {_sum_sql(_EVEN)}, {_UNMATCHED} select * from full_")
def headers_without_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = store.written(_picked(spark, sf_dir))  # read three times
    headers = hits.groupBy("header").agg(F.min("ordinal").alias("first_at"))
    return _flat(select.with_unmatched(select.summary(hits), headers))


@_query("select event_type, min(event_id) as first_at from events group by 1")
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_seen(_table(spark, sf_dir, "events"), "event_type", "event_id")


@_query(f"with {_sum_sql(_EVEN)}, {_UNMATCHED}, {_OWN} select o.table_id, o.ordinal, o.name, datatype, coalesce(vocab, element) as element, unit, method, description, case when coalesce(f.element_uri, '{{}}') = '{{}}' then '' else f.element_uri end as element_uri from own o left join full_ f on f.header = o.name")
def writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _picked(spark, sf_dir).withColumn("table_id", F.lit("vectors"))
    return export.to_csv_rows(pipelines.chosen(_own(spark, sf_dir), hits))


@_query(f"with {_OWN} select table_id, ordinal, name, datatype, element, unit, method, description, '' as element_uri from own")
def writeback_none_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _kept(spark, sf_dir).withColumns({"table_id": F.lit("vectors"), "selected": F.lit(False)})
    return export.to_csv_rows(pipelines.chosen(_own(spark, sf_dir), hits))


@_query(f"with {VOC} select label from voc where label is not null")
def label_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.labels(_terms(spark, sf_dir))


# -- metadata documents --


@_query(f"with {CAT} select table_id, name, nullif(datatype, '') as type, nullif(description, '') as description, unit, nullif(element, '') as title, nullif(element_uri, '') as element_uri from cat")
def tableschema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = export.to_table_schema(_catalogue(spark, sf_dir))
    return docs.select("table_id", F.inline(F.from_json("json", metadata.TABLE_SCHEMA)["fields"])).drop("method")


@_query(f"with {CAT} select table_id, name, case when element <> '' then concat('[\"', element, '\"]') end as titles, case when element_uri <> '' then concat('[\"http://vocab.example/', ordinal, '\"]') end as propertyUrl, unit, datatype, nullif(description, '') as description from cat")
def csvw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = export.to_csvw(_catalogue(spark, sf_dir))
    return docs.select("table_id", F.inline(F.from_json("json", metadata.CSVW)["tableSchema"]["columns"])).select("table_id", "name", "titles", "propertyUrl", "unit", "datatype", "description")


_BACK = f"with {CAT} select table_id, name, datatype, element, coalesce(unit, '') as unit, method, description, element_uri, cast(row_number() over (partition by table_id order by ordinal) - 1 as int) as seq from cat"


@_query(_BACK)
def tableschema_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_csv_rows(metadata.from_table_schema(export.to_table_schema(_catalogue(spark, sf_dir))))


@_query(_BACK)
def csvw_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_csv_rows(metadata.from_csvw(export.to_csvw(_catalogue(spark, sf_dir))))


@_query(f"with {CAT} select {META.replace('unit', '''coalesce(unit, '') as unit''')} from cat union all select {META.replace('unit', '''coalesce(unit, '') as unit''')} from cat")
def roundtrip_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _catalogue(spark, sf_dir)
    bare = own.select("table_id", "ordinal", "name")
    docs = export.to_table_schema(own).unionByName(export.to_csvw(own))
    return export.to_csv_rows(metadata.from_json(docs).drop("seq").join(bare, ["table_id", "name"])).select(*META.split(", "))


# -- prompts, answers, contexts --

def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(text.hinted(F.lit("doc_id"), F.lit("")), text.hinted(F.lit("lang"), F.col("lang")), F.lit("source"))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), F.lit(" local ").alias("provider"), F.col("text").alias("context"), names.alias("variables"))


_ASK = "Describe each variable of a dataset in one sentence, from the context alone.\nAnswer with one JSON object that maps each variable to its description.\nVariables: "
_JOINED = "concat('doc_id', {0}, 'lang (hint: ', lang, ')', {0}, 'source')"
_KEY = f"sha256(concat('local|', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '|', {_JOINED.format(chr(39) + ',' + chr(39))}))"


@_query(f"select doc_id as table_id, md5(concat('{_ASK}', {_JOINED.format(chr(39) + ', ' + chr(39))}, '\nContext:\n', substring(text, 1, 30000))) as prompt_md5 from documents")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.requests(_contexts(spark, sf_dir)).select("table_id", F.md5("prompt").alias("prompt_md5"))


@_query(f"select doc_id as table_id, {_KEY} as cache_key from documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.requests(_contexts(spark, sf_dir)).select("table_id", "cache_key")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that holds the answers for the labelled documents."""
    asked = answers.requests(_contexts(spark, sf_dir)).join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("table_id"), "quality"), "table_id")
    one = asked.groupBy("cache_key").agg(F.max_by(F.struct("context", "variables", "provider"), "table_id").alias("r"), F.max("quality").alias("q"))
    return one.select("cache_key", F.substring("r.context", 1, 500).alias("context_excerpt"), F.col("r.variables").alias("variables"), F.concat(F.lit("quality "), F.col("q").cast("string")).alias("response"), F.lit(3).alias("version"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.col("r.provider").alias("provider"))


_KEYED = f"keyed as (select doc_id, substring(text, 1, 500) as excerpt, {_KEY} as cache_key from documents), cache as (select cache_key, concat('quality ', max(quality)) as response, min(excerpt) as excerpt from keyed join labels using (doc_id) group by 1)"


@_query(f"with {_KEYED} select doc_id as table_id, k.cache_key, c.response as cached from keyed k left join cache c using (cache_key)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.looked_up(answers.requests(_contexts(spark, sf_dir)), _cache(spark, sf_dir))
    return found.select("table_id", "cache_key", "cached")


@_query(f"with {_KEYED} select cache_key, min(excerpt) as context_excerpt, concat('answer to ', count(*)) as response, cast(case when c.cache_key is null then 1 else 4 end as int) as version from keyed k left join (select cache_key from cache) c using (cache_key) group by cache_key, c.cache_key".replace("c.cache_key is null", "max(c.hit) is null").replace("(select cache_key from cache)", "(select cache_key, 1 as hit from cache)").replace("group by cache_key, c.cache_key", "group by cache_key"))
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = answers.requests(_contexts(spark, sf_dir))
    fresh = asked.groupBy("cache_key").agg(F.max_by(F.struct("context", "variables", "provider"), "table_id").alias("r"), F.count("*").alias("n")).select("cache_key", "r.*", F.concat(F.lit("answer to "), F.col("n").cast("string")).alias("response"))
    return answers.upserted(_cache(spark, sf_dir), fresh).select("cache_key", "context_excerpt", "response", "version")


def _described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata of one variable a document, their contexts, and a cache that holds the labelled documents' answers."""
    contexts = _contexts(spark, sf_dir).withColumn("table_id", F.col("table_id").cast("string"))
    blank = F.lit("")
    own = contexts.select("table_id", F.lit(0).alias("ordinal"), F.lit("lang").alias("name"), F.lit("string").alias("datatype"), *(blank.alias(c) for c in ("element", "unit", "method", "description")), F.lit(None).cast("map<string,string>").alias("element_uri"))
    cache = _cache(spark, sf_dir).withColumn("response", F.to_json(F.struct(F.col("response").alias("lang"))))
    return own, contexts, cache


def _provider(name: str, prompt: str) -> str:
    """A stand-in for a text provider: it tells the length of what it was asked."""
    return f'Sure: {{"lang": "{name.strip()} read {len(prompt)} characters"}}'


@_query(
    f"with {_KEYED}, said as (select cache_key, min(concat('local read ', length(concat('{_ASK}', {_JOINED.format(chr(39) + ', ' + chr(39))}, '\nContext:\n', substring(text, 1, 30000))), ' characters')) as fresh from documents join keyed using (doc_id) group by 1) "
    "select cast(doc_id as varchar) as table_id, coalesce(c.response, fresh) as description from keyed k join said using (cache_key) left join cache c using (cache_key)"
)
def describe_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a table's context; the cache holds the labelled ones' answers, others are asked for once a key."""
    return pipelines.described(*_described(spark, sf_dir), _provider)[0].select("table_id", "description")


class _Unsteady:
    """A stand-in for a text provider that fails for good on some requests and otherwise at every third call."""

    def __init__(self) -> None:
        self.calls = 0

    def __call__(self, name: str, prompt: str) -> str:
        self.calls += 1
        if len(prompt) % 10 == 7:
            raise ValueError("refused")
        if self.calls % 3 == 0:
            raise TimeoutError("late")
        return "No." if len(prompt) % 10 == 3 else _provider(name, prompt)


_SENT = f"length(concat('{_ASK}', {_JOINED.format(chr(39) + ', ' + chr(39))}, '\nContext:\n', substring(text, 1, 30000)))"


@_query(
    f"with {_KEYED}, said as (select doc_id, c.response, {_SENT} as n from documents join keyed using (doc_id) left join cache c using (cache_key)) "
    "select cast(doc_id as varchar) as table_id, case when response is not null then response when n % 10 in (3, 7) then '' else concat('local read ', n, ' characters') end as description, "
    "case when response is not null then null when n % 10 = 7 then 'ValueError: refused' when n % 10 = 3 then 'no JSON object in the answer' end as error from said"
)
def describe_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As describe_cached, by a provider that raises now and then, and always on some requests: those give errors, all others answers."""
    own, contexts, cache = _described(spark, sf_dir)
    done, _, errors = pipelines.described_with_errors(own, contexts, cache, _Unsteady())
    return done.select("table_id", "description").join(errors.select("table_id", "error"), "table_id", "left")


@_query(f"with {CAT}, {IMP}, {_LAST}, twins as (select table_id, ordinal * 2 + k as ordinal, name, datatype, element, unit, method, description, element_uri, k from cat cross join (select 0 as k union all select 1 union all select 2))"
    " select c.table_id, ordinal, c.name, datatype, case when k = 0 then coalesce(e, element) else element end as element, case when k = 0 then coalesce(u, unit) else unit end as unit, method, case when k = 0 then coalesce(d, description) else description end as description, element_uri from twins c left join last using (table_id, name)")
def merge_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column stands three times in its table: an import changes the first only."""
    twins = _catalogue(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("ordinal", F.col("ordinal") * 2 + F.col("k")).drop("k")
    return export.to_csv_rows(merge.merged(twins, _derived(spark, sf_dir, IMPORT), "yes"))


# -- files, written to the shared folder and read back --

DELIMITED = '''
select cast(right(p_brand, 1) as int) as file, p_partkey as line_no, case cast(right(p_brand, 1) as int) % 5
    when 0 then concat(p_name, ',"', p_type, ';x",', p_size)
    when 1 then concat(p_name, ';', p_type, ';', p_size, ';"a,b"')
    when 2 then concat(p_name, '|NA|1,5|', p_size)
    when 3 then concat(p_name, chr(9), '"say ""', p_type, '"""', chr(9), p_size)
    else p_name end as value from {part}
union all
select distinct cast(right(p_brand, 1) as int), cast(-1 as bigint), case cast(right(p_brand, 1) as int) % 5
    when 0 then 'name,kind,size' when 1 then 'name;kind;size;name' when 2 then 'name|kind||size' when 3 then concat('name', chr(9), 'kind', chr(9), 'size') else 'name' end from {part}'''
_CELL = """select file, {0} as ordinal, '{1}' as name, {2} as value from p where file % 5 {3}"""


@_query(
    "with p as (select cast(right(p_brand, 1) as int) as file, * from part) " + " union all ".join(
        _CELL.format(*x)
        for x in (
            (0, "name", "p_name", "< 5"),
            (1, "kind", "concat(p_type, ';x')", "= 0"), (2, "size", "p_size::varchar", "= 0"),
            (1, "kind", "p_type", "= 1"), (2, "size", "p_size::varchar", "= 1"), (3, "name.1", "'a,b'", "= 1"),
            (1, "kind", "null", "= 2"), (2, "Unnamed: 2", "'1,5'", "= 2"), (3, "size", "p_size::varchar", "= 2"),
            (1, "kind", "concat('say \"', p_type, '\"')", "= 3"), (2, "size", "p_size::varchar", "= 3"),
        )
    )
)
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five forms, written and read back as cells in one go."""
    path = store.new_path(spark)
    lines = _derived(spark, sf_dir, DELIMITED)
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "value").write.partitionBy("file").text(path)
    cells = tables.read_many(spark, path)
    return cells.select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("int").alias("file"), "ordinal", "name", "value")


@_query("""with p as (select *, case s_suppkey % 4 when 0 then 'Müller & Söhne' when 1 then 'café' when 2 then '10 €' else 'naïve – “quoted”' end as word, s_suppkey % 3 as file from supplier)
select file, 0 as ordinal, 'Name' as name, s_name as value from p union all select file, 1, 'Größe', word from p union all select file, 2, 'Straße', case when s_suppkey % 5 = 0 then null else concat('Nr. ', s_nationkey) end from p""")
def delimited_cp1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose bytes are Windows-1252 and no UTF-8, with characters that Latin-1 lacks: the charset is told from the lines."""
    path, word = store.new_path(spark), "case s_suppkey % 4 when 0 then 'M\xfcller & S\xf6hne' when 1 then 'caf\xe9' when 2 then '10 \x80' else 'na\xefve \x96 \x93quoted\x94' end"
    rows = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).alias("file"), F.col("s_name").alias("Name"), F.expr(word).alias("Gr\xf6\xdfe"), F.when(F.col("s_suppkey") % 5 == 0, "NA").otherwise(F.concat(F.lit("Nr. "), F.col("s_nationkey").cast("string"))).alias("Stra\xdfe"))
    # Latin-1 writes a character below 256 as that byte; bytes 128 to 159 are what Windows-1252 has of its own
    rows.repartition("file").write.options(sep=";", header=True, encoding="iso-8859-1").partitionBy("file").csv(path)
    return tables.read_many(spark, path).select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("file"), "ordinal", "name", "value")


def _workbook(rows: list[tuple]) -> bytes:
    """A small workbook of one sheet: text, number, date (serial 43831 on) and boolean columns under a header."""
    import io
    import zipfile

    space, out = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", io.BytesIO()
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABCD", ("name", "number", "day", "even"), strict=True))
    body = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{n}</t></is></c><c r="B{i}"><v>{k}</v></c><c r="C{i}" s="1"><v>{43831 + k % 365}</v></c><c r="D{i}" t="b"><v>{1 - k % 2}</v></c></row>' for i, (k, n) in enumerate(rows, 2))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{space}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData><row r="1">{head}</row>{body}</sheetData></worksheet>')
    return out.getvalue()


@_query(
    """with k as (select *, cast(c_custkey // 100 as varchar) as file, cast(row_number() over (partition by c_custkey // 100 order by c_custkey) - 1 as int) as row_id from customer)
select file, row_id, 0 as ordinal, 'name' as name, c_name as value from k union all select file, row_id, 1, 'number', c_custkey::varchar from k
union all select file, row_id, 2, 'day', strftime(date '2020-01-01' + (c_custkey % 365)::int, '%Y-%m-%d') from k union all select file, row_id, 3, 'even', case when c_custkey % 2 = 0 then 'True' else 'False' end from k"""
)
def workbook_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of a hundred customers each, made and read back: dates and booleans keep their kind."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [_workbook([(int(r["k"]), r["n"]) for r in rows]) for rows in b["rows"]]})

    books = _table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100).cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")))).alias("rows"))
    return tables.with_header(tables.sheet_cells(books.mapInPandas(made, "path string, content binary"))).drop("sheet")


@_query(
    f"""with cells as ({_oracle(SHEETS)}){_HEADER}, names as (select c.file, c.sheet, col, coalesce(max(case when row = header_row then nullif(trim(value), '') end), concat('col_', col)) as name from cells c join head using (file, sheet) where row >= header_row group by 1, 2, 3)
select c.file, c.sheet, c.row - header_row - 1 as row_id, string_agg(concat(name, '=', value), ';' order by c.col) as line from cells c join head using (file, sheet) join names n on n.file = c.file and n.sheet = c.sheet and n.col = c.col where c.row > header_row group by 1, 2, 3"""
)
def sheets_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets of a book as wide rows in one job."""
    wide = tables.wide_rows(_derived(spark, sf_dir, SHEETS))
    line = F.array_join(F.zip_with("names", "values", lambda n, v: F.concat(n, F.lit("="), v)), ";")
    return wide.select("file", "sheet", "row_id", line.alias("line"))


@_query(f"with {CAT} select table_id, name, datatype, nullif(element, '') as element, unit, nullif(description, '') as description, element_uri from cat")
def metadata_csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's CSV export, imported again; blanks come back as missing values."""
    path = store.new_path(spark)
    export.write_csv(_catalogue(spark, sf_dir), path)
    return export.to_csv_rows(metadata.read_metadata_csv(spark, path)).select("table_id", "name", "datatype", "element", "unit", "description", "element_uri")


_BRAND_NO = "cast(right(p_brand, 1) as int)"
_NO_LIST = f"'{metadata.NO_LIST}'"


@_query(
    f"""with p as (select concat('t', right(p_brand, 1)) as table_id, {_BRAND_NO} % 7 as form, * from part)
select table_id, p_name as name, null as datatype, p_type as element, 'm²' as unit, null as description, case when p_size % 2 = 0 then concat('{{"', p_type, '":"u', p_size, '"}}') else '' end as element_uri, null as _error from p where form = 0
union all select table_id, p_name, 'numeric', p_type, 'grün', concat('"', p_size, '"; x'), '', null from p where form = 1
union all select table_id, p_name, 'string', p_type, '', concat('size ', p_size), '', null from p where form = 2
union all select table_id, p_name, '', p_type, 'u', concat('size ', p_size), concat('{{"', p_type, '":"http://', p_size, '"}}'), null from p where form = 3
union all select distinct table_id, null, null, null, null, null, '', case form when 4 then 'no column name' when 5 then {_NO_LIST} else 'neither .csv nor .json' end from p where form > 3"""
)
def metadata_files_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata files of three good and three bad forms, written by brand and imported in one job; bad ones give an error row each."""
    base = store.new_path(spark)
    p = _table(spark, sf_dir, "part").withColumns({"table": F.concat(F.lit("t"), F.substring("p_brand", -1, 1)), "form": F.substring("p_brand", -1, 1).cast("int") % 7})
    parts = {n: p.where(F.col("form") == n).repartition("table").sortWithinPartitions("table") for n in range(7)}
    name, kind, size = F.col("p_name").alias("name"), F.col("p_type"), F.col("p_size").cast("string")
    listed = lambda df, *c: df.groupBy("table").agg(F.collect_list(F.struct(*c)).alias("items"))
    kept = {"escape": '"', "header": True, "emptyValue": ""}
    parts[0].select("table", name, kind.alias("Element"), F.lit("m²").alias("unit"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("u"), size)).alias("element_uri")).write.options(**kept).partitionBy("table").csv(f"{base}/0")
    parts[1].select("table", name, F.lit("numeric").alias("datatype"), kind.alias("element"), F.lit("grün").alias("unit"), F.concat(F.lit('"'), size, F.lit('"; x')).alias("DESCRIPTION")).write.options(**kept, sep=";", encoding="iso-8859-1").partitionBy("table").csv(f"{base}/1")
    described = F.concat(F.lit("size "), size).alias("description")
    listed(parts[2], name, F.lit("string").alias("type"), kind.alias("title"), described).withColumnRenamed("items", "fields").write.partitionBy("table").json(f"{base}/2")
    columns = listed(parts[3], name, F.array(kind, F.lit("other")).alias("titles"), F.lit("u").alias("unit"), described, F.concat(F.lit("http://"), size).alias("propertyUrl"))
    columns.select("table", F.struct(F.col("items").alias("columns")).alias("tableSchema")).write.partitionBy("table").json(f"{base}/3")
    parts[4].select("table", name.alias("Name"), kind.alias("unit")).write.options(**kept).partitionBy("table").csv(f"{base}/4")
    parts[5].groupBy("table").agg(F.struct(F.max("p_size").alias("a")).alias("fields")).write.partitionBy("table").json(f"{base}/5")
    parts[6].select("table", kind).write.partitionBy("table").text(f"{base}/6")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(base)
    found = metadata.metadata_of_files(files).withColumn("table_id", F.regexp_extract("path", "/table=([^/]+)/", 1))
    return found.select("table_id", "name", "datatype", "element", "unit", "description", F.coalesce(F.to_json("element_uri"), F.lit("")).alias("element_uri"), "_error")


@_query(f"with {_KEYED} select cache_key, response, 3 as version from cache")
def cache_store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark)
    answers.store_cache(_cache(spark, sf_dir), path)
    return answers.read_cache(spark, path).select("cache_key", "response", "version")


@_query(f"""with {_KEYED}, writer as (select cache_key, doc_id % 3 as w, min(length(text)) as n, min(excerpt) as excerpt from keyed join documents using (doc_id) group by 1, 2),
fresh as (select cache_key, count(*) as writers, concat('read ', min(n)) as response, min(excerpt) as context_excerpt from writer group by 1)
select f.cache_key, f.context_excerpt, f.response, cast(case when c.cache_key is null then 0 else 3 end + writers as int) as version from fresh f left join cache c on f.cache_key = c.cache_key""")
def cache_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers add answers to one stored cache at the same time; none is lost."""
    from concurrent.futures import ThreadPoolExecutor

    path = store.new_path(spark)
    answers.store_cache(_cache(spark, sf_dir), path)
    asked = answers.requests(_contexts(spark, sf_dir)).withColumn("response", F.concat(F.lit("read "), F.length("context").cast("string")))
    parts = [store.written(asked.where(F.col("table_id") % 3 == w)) for w in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda part: answers.upsert_cache(part, path), parts))
    return answers.read_cache(spark, path).select("cache_key", "context_excerpt", "response", "version")


@_query("select item_id::varchar as name, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from benchmark")
def context_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word processor's file of each benchmark item, made and read back."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        for b in batches:
            files = []
            for text in b["text"]:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:document>')
                files.append(out.getvalue())
            yield pd.DataFrame({"path": b["path"], "content": files})

    files = _table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".docx")).alias("path"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return context.document_texts(files.mapInPandas(made, "path string, content binary")).withColumn("name", F.regexp_replace("name", r"\.docx$", ""))


@_query(f"with {CAT}, {IMP}, {_LAST} select table_id, ordinal, name, case when datatype in ('numeric', 'date') then datatype else 'string' end as datatype, element, unit, method, description, element_uri from ({_YES})")
def import_and_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_csv_rows(pipelines.imported(_catalogue(spark, sf_dir), _derived(spark, sf_dir, IMPORT)))


@_query(f"with {CAT} select table_id, name, coalesce(unit, '') as unit, coalesce(description, '') as description, ordinal from cat")
def export_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue through the TableSchema export and back."""
    own = _catalogue(spark, sf_dir)
    back = metadata.from_json(pipelines.exported(own, "tableschema"))
    return back.join(own.select("table_id", "name", "ordinal"), ["table_id", "name"]).select("table_id", "name", "unit", "description", "ordinal")


@_query(f"with {CAT} select 'csvw' as form, table_id, name, coalesce(unit, '') as unit, coalesce(description, '') as description, ordinal from cat union all select 'csv', table_id, name, unit, nullif(description, ''), ordinal from cat")
def export_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue through the CSVW export and, as a file, the CSV export, and back."""
    own, path = _catalogue(spark, sf_dir), store.new_path(spark)
    place = own.select("table_id", "name", "ordinal")
    pipelines.exported(own, "csv").write.options(header=True, escape='"').csv(path)
    back = metadata.from_json(pipelines.exported(own, "csvw")).withColumn("form", F.lit("csvw")).select("form", "table_id", "name", "unit", "description")
    back = back.unionByName(metadata.read_metadata_csv(spark, path).withColumn("form", F.lit("csv")).select("form", "table_id", "name", "unit", "description"))
    return back.join(place, ["table_id", "name"]).select("form", "table_id", "name", "unit", "description", "ordinal")


# -- answers of providers --

_OBJECT = """concat('{"variable_', conv_id, '":"turn ', turn, ' of ', role, '"}')"""
_ANSWER = f"""case turn % 5 when 0 then {_OBJECT} when 1 then concat('```json', chr(10), {_OBJECT}, chr(10), '```') when 2 then concat('Here it is: ', {_OBJECT}, ' as asked.') when 3 then 'I cannot say.' else '{{"variable": ' end"""


@_query(f"""select conv_id * 1000 + turn as table_id, case when ok then concat('variable_', conv_id) end as name, case when ok then concat('turn ', turn, ' of ', role) end as description, not ok as parse_error from (select *, turn % 5 < 3 as ok from conversations)""")
def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("table_id"), F.expr(_ANSWER).alias("response"))
    return answers.described(said)


@_query("select conv_id, md5(string_agg(concat(trim(text), chr(10)), '' order by turn)) as context_md5 from conversations group by conv_id")
def context_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = context.assembled(_table(spark, sf_dir, "conversations"), ("conv_id",), "turn")
    return joined.select("conv_id", F.md5("context").alias("context_md5"))


_TALK = "(select conv_id, string_agg(concat(trim(text), chr(10)), '' order by turn) as c from conversations group by conv_id)"
_TALKS = "(select 'talks' as conv_id, string_agg(concat(trim(text), chr(10)), '' order by conv_id, turn) as c from conversations)"


@_query(
    "select conv_id, sha256(concat('local|', regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '|role,text')) as cache_key, "
    f"md5(concat('{_ASK}', 'role, text', '\nContext:\n', substring(c, 1, 30000))) as prompt_md5 from (select conv_id::varchar as conv_id, c from {_TALK} union all select * from {_TALKS})"
)
def context_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with each conversation as a context, and with all of them as one, which no task holds."""
    turns = _table(spark, sf_dir, "conversations")
    each = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("seq"), "text")
    both = each.unionByName(turns.select(F.lit("talks").alias("conv_id"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), "text"))
    asked = both.select("conv_id").distinct().select("conv_id", F.lit(" local ").alias("provider"), F.array(F.lit("role"), F.lit("text")).alias("variables"))
    return context.streamed_requests(both, asked, ("conv_id",)).select("conv_id", "cache_key", F.md5("prompt").alias("prompt_md5"))


@_query("select page_id, md5(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', chr(10), 'g'), '(?s)<style.*?</style>', chr(10), 'g'), '<[^>]*>', chr(9), 'g'), '[^ \\t\\n\\r\\f\\v]+'), ' ')) as text_md5 from pages")
def context_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.page_texts(_table(spark, sf_dir, "pages")).select("page_id", F.md5("text").alias("text_md5"))


def _hashed(text: str, dim: int = 64) -> str:
    """SQL of vectors.hashed_vector()."""
    numbers = f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '\\p{{L}}+'), lambda w: ('0x' || substring(md5(w), 1, 4))::int)"
    places = f"list_transform({numbers}, lambda h: case when h < 32768 then h % {dim} else h % {dim} - {dim} end)"
    counts = f"(select list_transform(range({dim}), lambda d: coalesce(c[d], 0)::bigint - coalesce(c[d - {dim}], 0)::bigint) from (select histogram(x) as c from (select unnest({places}) as x)))"
    return f"(select list_transform(v, lambda x: case when s > 0 then round(x / s * {vectors.STEPS}) / {vectors.STEPS} else 0.0::double end) from (select v, sqrt(list_sum(list_transform(v, lambda x: x * x))::double) as s from (select coalesce({counts}, list_transform(range({dim}), lambda d: 0)) as v)))"


_APART = "list_sum(list_transform(list_zip(q.v, t.v), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"


@_query(f"""with q as (select doc_id, {_hashed("text")} as v from documents), t as (select item_id as id, {_hashed("text")} as v from benchmark)
select doc_id, id, round(distance, 6) as distance, cast(rank as int) as rank from (select *, row_number() over (partition by doc_id order by distance, id) as rank from (select doc_id, id, {_APART} as distance from q cross join t)) where rank <= 4""")
def hash_encode_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents matched with the benchmark's items as terms, by the stand-in encoder."""
    encoder = vectors.hashed_vector
    terms = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), encoder(F.col("text")).alias("vector"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query"), encoder(F.col("text")).alias("vector"))
    return _rounded(match.nearest(docs, terms)).withColumnRenamed("query", "doc_id")


#: The user's terms are the kinds and names of parts, one uri for each name; the columns are the parts, in tables by brand. Halves keep every sum exact.
KINDS = """select row_number() over (order by label) as id, concat('http://kinds.example/', replace(p_name, ' ', '-')) as uri, label, concat('definition of ', label) as definition,
  case when length(label) % 2 = 0 then 'prefLabel' else 'altLabel' end as qc_label from (select distinct p_name, concat(p_type, ' ', p_name) as label from {part})"""


@_query(f"""with {CAT}, kinds as ({_oracle(KINDS)}), t as (select *, {_hashed("label")} as v from kinds),
w as (select table_id, ordinal, name as header, {_hashed("name")} as a, {_hashed("description")} as d, trim(coalesce(description, '')) <> '' and lower(trim(description)) <> 'nan' as defined from (select * replace (concat(element, ' ', name) as name) from cat)),
q as (select table_id, ordinal, header, case when defined then list_transform(list_zip(a, d), lambda p: 0.5 * p[1] + 0.5 * p[2]) else a end as v from w),
near as (select *, row_number() over (partition by table_id, ordinal order by distance, id) as rank from (select table_id, ordinal, header, id, uri, label, definition, qc_label, {_APART} as distance from q cross join t) qualify rank <= 4)
select table_id, ordinal, header, id, uri, label, definition as term_definition, qc_label, round(distance, 6) as distance from near
qualify row_number() over (partition by table_id, ordinal, uri order by case qc_label when 'prefLabel' then 0 when 'altLabel' then 1 else 2 end, distance, id) = 1""")
def match_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main user step: names and descriptions of all columns, encoded, blended, matched with a vocabulary, one hit for each uri."""
    own = _catalogue(spark, sf_dir).withColumn("name", F.concat("element", F.lit(" "), "name"))
    terms = _derived(spark, sf_dir, KINDS).withColumn("embedding", vectors.hashed_vector(F.col("label")))
    return _rounded(pipelines.matched(own, terms, vectors.hashed_vector, alpha=0.5, native=True))


@_query("""select page_id, concat('<a href="', url, '" target="_blank">', url, '</a>, <a href="http://vocab.example/', page_id, '" target="_blank">http://vocab.example/', page_id, '</a>') as links from pages""")
def clickable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    uris = F.array(F.col("url"), F.concat(F.lit("http://vocab.example/"), F.col("page_id").cast("string")))
    return _table(spark, sf_dir, "pages").select("page_id", text.links(uris).alias("links"))
