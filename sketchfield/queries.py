"""The registered queries over the filter operators, and the SQL that they equal.

Filters and slices are sized by a count of their keys, in the query and in its SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import composite
from .operators import cardinality, chains, counting, growing, ledger, membership, packed, reports, trees
from .plans import sizing
from .plans.slices import Growth, Slice, TreePlan, predict_fpr, sharded_plan, slice_plan
from .plans.sizing import Spec
from .operators.scratch import checkpointed, shared_folder
from .sources import store
from .sources.growing_store import GrowingStore
from .streaming import counting_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _h(key: str, number: int = 1) -> str:
    text = f"CAST({key} AS VARCHAR)"
    if number == 3:
        text = f"{text} || '|3'"
    return f"('0x' || substr(md5({text}), {17 if number == 2 else 1}, 15))::BIGINT"


def _std(n: str, p: float | str = 0.01) -> str:
    """The size (n, m, kk, groups) of a filter for ``n`` keys, an SQL number."""
    return f"""SELECT n, m, greatest(1, least(32, floor(m / n * ln(2.0) + 0.5)))::BIGINT AS kk, 1::BIGINT AS groups
  FROM (SELECT n, greatest(8, ceil(-n * ln({p}) / (ln(2.0) * ln(2.0))))::BIGINT AS m FROM (SELECT greatest(1, ({n}))::BIGINT AS n))"""


_SIZES = {
    "standard": _std,
    "rehash": _std,
    "partitioned": lambda n, p=0.01: f"SELECT n, greatest(512, ceil(ceil(m / kk) / 512) * 512)::BIGINT AS m, kk, kk AS groups FROM ({_std(n, p)})",
    "block": lambda n, p=0.01: f"SELECT n, 512::BIGINT AS m, least(16, greatest(2, floor(blocks * 512 / n * ln(2.0) + 0.5)))::BIGINT AS kk, blocks AS groups FROM (SELECT n, pow(2, ceil(log2(ceil(m / 512))))::BIGINT AS blocks FROM ({_std(n, f'{p} / 2.5')}))",
    "sharded": lambda n, p=0.01: f"SELECT n, m, kk, 8::BIGINT AS groups FROM ({_std(f'ceil(({n}) / 8)', p)})",
}


def _at(keys: str, layout: str = "standard", strategy: str = "enhanced", sizes: str | None = "sp") -> str:
    """Of a query with columns k and o (owner), and sizes m, kk and groups unless a table has them: k, o, i, grp, pos."""
    source, own = (f"({keys}), {sizes}", "k, o, m, kk, groups") if sizes else (f"({keys})", "k, o, m, kk, groups")
    if layout == "rehash":
        h = _h("CAST(k AS VARCHAR) || '#' || i")
        return f"SELECT k, o, i, 0 AS grp, {h} % m AS pos FROM (SELECT {own}, unnest(range(kk)) AS i FROM {source})"
    h = f"SELECT {own}, {_h('k')} AS h1, {_h('k', 2)} AS h2, {_h('k', 3) if strategy == 'triple' else '0'} AS h3 FROM {source}"
    lead = "(h1 // groups)" if layout == "sharded" else "h1"
    step = {"double": "0", "enhanced": "i * (i + 1) // 2", "triple": "i * i * (h3 % m)"}["double" if layout == "partitioned" else strategy]
    grp, pos = "0", f"({lead} % m + i * (h2 % m) + {step}) % m"
    if layout == "partitioned":
        grp = "i"
    elif layout == "sharded":
        grp = "h1 % groups"
    elif layout == "block":
        grp, pos = "h1 % groups", "(h2 % 512 + i * (h2 // 512 % 256 * 2 + 1)) % 512"
    return f"SELECT k, o, i, {grp} AS grp, {pos} AS pos FROM (SELECT *, unnest(range(kk)) AS i FROM ({h}))"


def _filter_sql(name: str, keys: str, layout: str = "standard", sizes: str = "sp") -> str:
    """A common table of a filter's distinct (o, grp, pos)."""
    return f"{name} AS (SELECT DISTINCT o, grp, pos FROM ({_at(f'SELECT k, o FROM ({keys}) WHERE k IS NOT NULL', layout, sizes=sizes)}))"


def _probe_sql(name: str, probes: str, filter_name: str, layout: str = "standard", sizes: str = "sp") -> str:
    """A common table (k, maybe) of distinct keys."""
    at = _at(f"SELECT DISTINCT k, '' AS o FROM ({probes}) WHERE k IS NOT NULL", layout, sizes=sizes)
    return f"{name} AS (SELECT p.k, bool_and(f.pos IS NOT NULL) AS maybe FROM ({at}) p LEFT JOIN {filter_name} f ON p.grp = f.grp AND p.pos = f.pos GROUP BY p.k)"


def _keys(df: DataFrame, key: str | Column) -> int:
    """How many rows have a key: what a filter is sized for."""
    return max(1, df.where((F.col(key) if isinstance(key, str) else key).isNotNull()).count())


def _distinct(df: DataFrame, key: str) -> int:
    return max(1, df.agg(F.countDistinct(key)).first()[0])


# sizing ---------------------------------------------------------------------------------------

_RATES = (0.1, 0.01, 0.001, 0.0001)


@query(f"""
WITH g AS (SELECT o_orderpriority, count(*) AS n, unnest([{", ".join(f"{p}::DOUBLE" for p in _RATES)}]) AS p FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
b AS (SELECT *, greatest(8, ceil(-n * ln(p) / (ln(2.0) * ln(2.0))))::BIGINT AS bits FROM g),
h AS (SELECT *, least(32, greatest(1, floor(bits / n * ln(2.0) + 0.5)))::BIGINT AS hashes FROM b)
SELECT o_orderpriority, n, p, bits, hashes, round(pow(1 - exp(-hashes * n / bits), hashes), 9) AS expected_fpr, round(-ln(p) / (ln(2.0) * ln(2.0)), 9) AS bits_per_item FROM h
""")
def sizing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of filters for the orders of each priority, at four rates."""
    found = _t(spark, sf_dir, "orders").where("o_orderpriority is not null").groupBy("o_orderpriority").count().collect()  # a handful of priorities
    rows = [(g, n, p, m := sizing.optimal_bit_count(n, p), k := sizing.optimal_hash_count(m, n), round(sizing.expected_fp_rate(m, n, k), 9), round(sizing.bits_per_element(p), 9)) for g, n in found for p in _RATES]
    return spark.createDataFrame(rows, "o_orderpriority string, n long, p double, bits long, hashes long, expected_fpr double, bits_per_item double")


# standard filters -----------------------------------------------------------------------------

_URGENT_KEYS = "SELECT o_orderkey AS k, '' AS o FROM orders WHERE o_orderpriority = '1-URGENT'"
_URGENT_SQL = f"sp AS ({_std(f'SELECT count(k) FROM ({_URGENT_KEYS})')}), {_filter_sql('f', _URGENT_KEYS)}"
_LINES_SQL = "SELECT l_orderkey AS k FROM lineitem"


def _urgent(spark: SparkSession, sf_dir: str, rate: float = 0.01) -> tuple[DataFrame, Spec]:
    orders = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    spec = sizing.standard(_keys(orders, "o_orderkey"), rate)
    return membership.build(orders, "o_orderkey", spec), spec


@query(f"WITH {_URGENT_SQL} SELECT pos // 64 AS word, count(*) AS set_bits FROM f GROUP BY 1")
def std_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urgent(spark, sf_dir)[0].select("word", F.bit_count("bits").cast("long").alias("set_bits"))


@query(
    f"WITH {_URGENT_SQL}, {_probe_sql('hit', _LINES_SQL, 'f')} SELECT l_returnflag, count(*) AS n_rows, sum(l_quantity) AS quantity FROM lineitem JOIN hit ON k = l_orderkey WHERE maybe GROUP BY 1"
)
def std_contains_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = membership.semi_join(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), "l_orderkey", *_urgent(spark, sf_dir))
    return hit.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query(f"WITH {_URGENT_SQL}, {_probe_sql('hit', _LINES_SQL, 'f')} SELECT l_orderkey, l_linenumber FROM lineitem JOIN hit ON k = l_orderkey WHERE NOT maybe")
def std_not_contains_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.anti_join(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", *_urgent(spark, sf_dir))


@query(f"WITH {_URGENT_SQL}, {_probe_sql('hit', _LINES_SQL, 'f')} SELECT k AS l_orderkey FROM hit WHERE maybe")
def std_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe by joins, as for filters that are too large to broadcast."""
    keys = _t(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return membership.probe(keys, "l_orderkey", *_urgent(spark, sf_dir), broadcast_bytes=0).where("maybe").select("l_orderkey")


_NAMES = "SELECT c_name AS k, '' AS o FROM customer WHERE c_acctbal > 0"


@query(
    f"WITH sp AS ({_std(f'SELECT count(k) FROM ({_NAMES})')}), {_filter_sql('f', _NAMES)}, {_probe_sql('hit', 'SELECT c_name AS k FROM customer', 'f')} SELECT c_custkey, maybe FROM customer JOIN hit ON k = c_name"
)
def std_contains_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _t(spark, sf_dir, "customer")
    known = customer.where("c_acctbal > 0")
    spec = sizing.standard(_keys(known, "c_name"), 0.01)
    return membership.probe(customer, "c_name", membership.build(known, "c_name", spec), spec).select("c_custkey", "maybe")


@query(
    f"WITH {_URGENT_SQL}, {_probe_sql('hit', 'SELECT o_orderkey AS k FROM orders', 'f')} SELECT o_custkey, bool_and(maybe) AS contains_all, bool_or(maybe) AS contains_any FROM orders JOIN hit ON k = o_orderkey GROUP BY 1"
)
def contains_all_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = membership.probe(_t(spark, sf_dir, "orders"), "o_orderkey", *_urgent(spark, sf_dir))
    return probed.groupBy("o_custkey").agg(F.bool_and("maybe").alias("contains_all"), F.bool_or("maybe").alias("contains_any"))


def _stats_sql(source: str) -> str:
    bits = "(m * groups)"
    return f"""SELECT set_bits, round(set_bits / {bits}, 9) AS fill_rate, round(pow(set_bits / {bits}, kk), 9) AS estimated_fpr,
  CASE WHEN set_bits = 0 THEN 0 WHEN set_bits < {bits} THEN floor(-({bits} / kk) * ln(1 - set_bits / {bits})) END::BIGINT AS estimated_items, set_bits / {bits} > 0.5 AS saturated
  FROM (SELECT count(*) AS set_bits FROM {source}), sp"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


_TEXTS_SQL = f"sp AS ({_std('SELECT count(DISTINCT text) FROM documents')}), {_filter_sql('f', '''SELECT text AS k, '' AS o FROM documents''')}"


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    docs = _t(spark, sf_dir, "documents")
    spec = sizing.standard(_distinct(docs, "text"), 0.01)
    return membership.build(docs, "text", spec), spec


@query(f"WITH {_TEXTS_SQL} {_stats_sql('f')}")
def fill_fpr_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, spec = _texts(spark, sf_dir)
    return _rounded(membership.statistics(words, spec), "fill_rate", "estimated_fpr")


@query(f"""
WITH {_TEXTS_SQL}, s AS ({_stats_sql('f')}) SELECT *, round(estimated_fpr / 0.01, 6) AS fpr_ratio,
CASE WHEN fill_rate < 0.5 AND estimated_fpr / 0.01 < 2 THEN 'Healthy' WHEN fill_rate < 0.7 AND estimated_fpr / 0.01 < 5 THEN 'Degraded' ELSE 'Critical' END AS state FROM s
""")
def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, spec = _texts(spark, sf_dir)
    return _rounded(membership.health(words, spec), "fill_rate", "estimated_fpr").withColumn("fpr_ratio", F.round(F.col("estimated_fpr") / 0.01, 6))


# algebra: part keys by the quantity ordered, of which any two share some ---------------------------

_LOTS = "SELECT l_partkey AS k, CAST(l_quantity AS INT) AS o FROM lineitem WHERE l_quantity <= 3"
_LOTS_SQL = f"sp AS ({_std('SELECT count(*) FROM part')}), {_filter_sql('f', _LOTS)}"


def _lots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    """Filters 1, 2 and 3 in one table."""
    spec = sizing.standard(max(1, _t(spark, sf_dir, "part").count()), 0.01)
    lines = _t(spark, sf_dir, "lineitem").where("l_quantity <= 3")
    return membership.build(lines, "l_partkey", spec, F.col("l_quantity").cast("int")), spec


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Spec, Spec]:
    """Filters of the parts ordered once, and twice, at a time."""
    words, spec = _lots(spark, sf_dir)
    one = lambda n: words.where(F.col("filter_id") == str(n)).withColumn("filter_id", F.lit(""))
    return one(1), one(2), spec, spec


def _both(how: str) -> str:
    return f"WITH {_LOTS_SQL} SELECT pos FROM f WHERE o IN (1, 2) GROUP BY pos HAVING {how}"


@query(_both("true"))
def filter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.set_positions(membership.union(*_two(spark, sf_dir))).select("pos")


@query(_both("count(*) = 2"))
def filter_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.set_positions(membership.intersect(*_two(spark, sf_dir))).select("pos")


@query(_both("count(*) = 1"))
def filter_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.set_positions(membership.xor(*_two(spark, sf_dir))).select("pos")


@query(f"""
WITH {_LOTS_SQL}, b AS (SELECT pos, bool_or(o = 1) AS x, bool_or(o = 2) AS y FROM f WHERE o IN (1, 2) GROUP BY pos),
s AS (SELECT count(*) AS union_bits, count(*) FILTER (x AND y) AS common_bits, count(*) FILTER (x != y) AS hamming, count(*) FILTER (x) AS a_bits, count(*) FILTER (y) AS b_bits FROM b)
SELECT *, round(common_bits / union_bits, 9) AS jaccard, common_bits = a_bits AS a_in_b, common_bits = 0 AS disjoint, hamming = 0 AS equal FROM s
""")
def filter_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(membership.compare(*_two(spark, sf_dir)), "jaccard")


@query(f"""
WITH {_LOTS_SQL}, b AS (SELECT pos, bool_or(o = 1) AS x, count(*) = 2 AS common FROM f WHERE o IN (1, 2) GROUP BY pos)
SELECT 'common in one' AS pair, true AS a_in_b, false AS disjoint, count(*) FILTER (common) AS common_bits FROM b
UNION ALL SELECT 'one and the rest', false, true, 0 FROM (SELECT 1) UNION ALL SELECT 'one and itself', true, false, count(*) FILTER (x) FROM b
""")
def filter_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose relation is known: an intersection and a part of it, a filter and what only others have, a filter and itself."""
    a, b, spec, _ = _two(spark, sf_dir)
    common, rest = membership.intersect(a, b, spec, spec), membership.intersect(membership.xor(a, b, spec, spec), b, spec, spec)
    pairs = {"common in one": (common, a), "one and the rest": (a, rest), "one and itself": (a, a)}
    parts = [membership.compare(x, y, spec, spec).select(F.lit(name).alias("pair"), "a_in_b", "disjoint", "common_bits") for name, (x, y) in pairs.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {_LOTS_SQL} SELECT DISTINCT pos FROM f")
def union_many_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.set_positions(membership.union_many(_lots(spark, sf_dir)[0])).select("pos")


@query(f"WITH {_LOTS_SQL} SELECT pos FROM f GROUP BY pos HAVING count(*) = 3")
def intersect_many_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.set_positions(membership.intersect_many(_lots(spark, sf_dir)[0], 3)).select("pos")


@query(f"WITH {_LOTS_SQL} SELECT o AS filter_id, count(*) AS set_bits FROM f GROUP BY 1")
def grouped_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lots(spark, sf_dir)[0].groupBy(F.col("filter_id").cast("int").alias("filter_id")).agg(F.sum(F.bit_count("bits").cast("long")).alias("set_bits"))


@query(f"WITH {_URGENT_SQL}, s AS (SELECT pos FROM f UNION SELECT unnest(range(100, 150))) SELECT pos FROM s WHERE NOT pos BETWEEN 200 AND 329 AND pos != 500")
def bit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, spec = _urgent(spark, sf_dir)
    words = membership.set_range(membership.set_range(words, spec.m, 100, 150), spec.m, 200, 330, value=False)
    return membership.set_positions(membership.set_bit(words, spec.m, 500, value=False)).select("pos")


@query(f"WITH {_URGENT_SQL} SELECT r.pos, f.pos IS NOT NULL AS bit FROM range(100, 400) r(pos) LEFT JOIN f ON f.pos = r.pos")
def bit_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, spec = _urgent(spark, sf_dir)
    return membership.get_range(words, spec.m, 100, 400)


# index strategies and layouts -----------------------------------------------------------------

_PARTS = "SELECT count(*) FROM part WHERE p_size <= 25"


def _strategy(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = _t(spark, sf_dir, "part")
        spec = sizing.standard(_keys(part, "p_partkey"), 0.01, strategy=name)
        at = membership.positions(part, "p_partkey", spec, [F.col("p_partkey").alias("k")])
        return at.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("pos")).cast("array<string>"), ",").alias("positions"))

    run.__name__ = f"positions_{name}"
    at = _at("SELECT p_partkey AS k, '' AS o FROM part", strategy=name)
    query(f"WITH sp AS ({_std('SELECT count(*) FROM part')}) SELECT k, string_agg(pos, ',' ORDER BY pos) AS positions FROM ({at}) GROUP BY k")(run)


for _name in ("double", "enhanced", "triple"):
    _strategy(_name)

LAYOUTS = {
    "partitioned": sizing.partitioned,
    "block": sizing.blocked,
    "rehash": sizing.rehashed,
    "sharded": lambda n, p, **more: sizing.sharded(n, p, 8, **more),
}


def _layout(name: str) -> None:
    keys = "SELECT p_partkey AS k, '' AS o FROM part WHERE p_size <= 25"

    def words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
        known = _t(spark, sf_dir, "part").where("p_size <= 25")
        spec = LAYOUTS[name](_keys(known, "p_partkey"), 0.01)
        return membership.build(known, "p_partkey", spec), spec

    def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
        return membership.probe(_t(spark, sf_dir, "part"), "p_partkey", *words(spark, sf_dir)).select("p_partkey", "maybe")

    def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
        return membership.probe(_t(spark, sf_dir, "part"), "p_partkey", *words(spark, sf_dir), broadcast_bytes=0).select("p_partkey", "maybe")

    def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(membership.statistics(*words(spark, sf_dir), ["grp"]).select("grp", "set_bits", "fill_rate"), "fill_rate")

    def total(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(membership.statistics(*words(spark, sf_dir)), "fill_rate", "estimated_fpr")

    def algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = _t(spark, sf_dir, "part")
        spec = LAYOUTS[name](_keys(part.where("p_size <= 25"), "p_partkey"), 0.01)
        a, b = (membership.build(part.where(x), "p_partkey", spec) for x in ("p_size <= 25", "p_size > 15"))
        return _rounded(membership.compare(a, b, spec, spec), "jaccard")

    filtered = f"sp AS ({_SIZES[name](_PARTS)}), {_filter_sql('f', keys, name)}"
    probe = f"WITH {filtered}, {_probe_sql('hit', 'SELECT p_partkey AS k FROM part', 'f', name)} SELECT p_partkey, maybe FROM part JOIN hit ON k = p_partkey"
    two = f"""WITH sp AS ({_SIZES[name](_PARTS)}), {_filter_sql('x', keys, name)}, {_filter_sql('y', "SELECT p_partkey AS k, '' AS o FROM part WHERE p_size > 15", name)},
b AS (SELECT x.pos IS NOT NULL AS x, y.pos IS NOT NULL AS y FROM x FULL JOIN y ON x.grp = y.grp AND x.pos = y.pos),
s AS (SELECT count(*) AS union_bits, count(*) FILTER (x AND y) AS common_bits, count(*) FILTER (x != y) AS hamming, count(*) FILTER (x) AS a_bits, count(*) FILTER (y) AS b_bits FROM b)
SELECT *, round(common_bits / union_bits, 9) AS jaccard, common_bits = a_bits AS a_in_b, common_bits = 0 AS disjoint, hamming = 0 AS equal FROM s"""
    for f, suffix, sql in (
        (contains, "contains", probe),
        (contains_join, "contains_join", probe),
        (stats, "group_stats", f"WITH {filtered} SELECT grp, count(*) AS set_bits, round(count(*) / any_value(m), 9) AS fill_rate FROM f, sp GROUP BY 1"),
        (total, "stats", f"WITH {filtered} {_stats_sql('f')}"),
        (algebra, "compare", two),
    ):
        f.__name__ = f"{name}_{suffix}"
        query(sql)(f)


for _name in LAYOUTS:
    _layout(_name)

_ALL_PARTS = "SELECT p_partkey AS k, '' AS o FROM part"


@query(f"""
WITH sp AS ({_SIZES['sharded']('SELECT count(*) FROM part')}), {_filter_sql('f', _ALL_PARTS, 'sharded')}, s AS (SELECT grp AS shard, count(*) AS set_bits FROM f GROUP BY 1)
SELECT shard, set_bits, abs(set_bits - avg(set_bits) OVER ()) > 0.02 * avg(set_bits) OVER () AS imbalanced FROM s
""")
def shard_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    spec = LAYOUTS["sharded"](_keys(part, "p_partkey"), 0.01)
    return membership.imbalance(
        membership.statistics(membership.build(part, "p_partkey", spec), spec, ["grp"]),
        0.02,
    ).select(F.col("grp").alias("shard"), "set_bits", "imbalanced")


@query(
    f"WITH sp AS ({_std('SELECT count(*) FROM part')}), {_filter_sql('f', _ALL_PARTS)} SELECT pos * 256 // m AS stripe, count(*) AS set_bits FROM f, sp GROUP BY 1 ORDER BY set_bits DESC, stripe LIMIT 10"
)
def striped_top_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the ten fullest of 256 stripes."""
    part = _t(spark, sf_dir, "part")
    spec = sizing.standard(_keys(part, "p_partkey"), 0.01)
    return membership.stripes(membership.build(part, "p_partkey", spec), spec).orderBy(F.desc("set_bits"), "stripe").limit(10)


# counting -------------------------------------------------------------------------------------


def _hits_sql(keys: str, sizes: str = "sp") -> str:
    return f"SELECT pos, count(*) AS hits FROM ({_at(f'SELECT k, o FROM ({keys}) WHERE k IS NOT NULL', sizes=sizes)}) GROUP BY pos"


_USERS_SQL = f"""sp AS ({_std('SELECT count(DISTINCT user_id) FROM events')}), h AS ({_hits_sql("SELECT user_id AS k, '' AS o FROM events")}),
c AS (SELECT pos, least(hits, 15) AS cnt, greatest(hits - 15, 0) AS overflow FROM h)"""


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    events = _t(spark, sf_dir, "events")
    spec = sizing.standard(_distinct(events, "user_id"), 0.01)
    return counting.build(events, "user_id", spec), spec


@query(f"WITH {_USERS_SQL} SELECT pos, cnt, overflow FROM c")
def counting_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir)[0]


@query(
    f"WITH {_USERS_SQL}, v AS (SELECT unnest(range(16)) AS cnt), n AS (SELECT cnt, count(*) AS n FROM c GROUP BY 1) SELECT v.cnt, CASE WHEN v.cnt = 0 THEN (SELECT m FROM sp) - (SELECT count(*) FROM c) ELSE coalesce(n, 0) END AS counters FROM v LEFT JOIN n ON v.cnt = n.cnt"
)
def counting_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.histogram(*_users(spark, sf_dir))


_DISTRIBUTION = f"""{_USERS_SQL}, d AS (SELECT coalesce(cnt, 0) AS cnt FROM (SELECT unnest(range((SELECT m FROM sp))) AS pos) LEFT JOIN c USING (pos)),
e AS (SELECT count(*) FILTER (cnt > 0) AS nonzero, min(cnt) AS min_count, max(cnt) AS max_count, round(avg(cnt), 9) AS mean, round(stddev_pop(cnt), 9) AS stddev,
  round(avg(cnt) FILTER (cnt > 0), 9) AS avg_nonzero, count(*) FILTER (cnt >= 13) AS saturated, round(pow(max(cnt) / 15, 2), 9) AS overflow_risk, round(least(stddev_pop(cnt) / avg(cnt), 1), 9) AS fragmentation, 4.0::DOUBLE AS compression_ratio FROM d)"""


@query(f"WITH {_DISTRIBUTION} SELECT * FROM e")
def counting_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(counting.distribution(*_users(spark, sf_dir)), "mean", "stddev", "avg_nonzero", "overflow_risk", "fragmentation")


@query(f"""
WITH {_DISTRIBUTION}, i AS (SELECT count(user_id) AS items FROM events), o AS (SELECT sum(overflow) AS overflows FROM c)
SELECT round(nonzero / m, 9) AS fill_rate, round(pow(1 - exp(-kk * items / m), kk), 9) AS estimated_fpr, 0.01::DOUBLE AS target_fpr, max_count AS max_counter_value, avg_nonzero AS avg_counter_value, saturated AS saturated_count,
  overflows::BIGINT AS overflow_events, overflow_risk, ceil(m * 4 / 8)::BIGINT AS memory_bytes, nonzero AS active_counters, m AS total_counters, round(items / n, 9) AS load_factor, items AS estimated_item_count, round(saturated / m, 9) AS saturation_rate,
  compression_ratio AS memory_overhead, min_count AS distribution_min, max_count AS distribution_max, mean AS distribution_mean, stddev AS distribution_stddev, round(1 - nonzero / m, 9) AS zero_rate, fragmentation FROM e, sp, i, o
""")
def counting_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters, spec = _users(spark, sf_dir)
    items, overflows = _keys(_t(spark, sf_dir, "events"), "user_id"), counters.agg(F.sum("overflow")).first()[0] or 0
    row = counting.health(counters, spec, items, overflows)
    return _rounded(row, *(c for c, kind in row.dtypes if kind == "double" and c not in ("target_fpr", "memory_overhead")))


@query(f"WITH {_USERS_SQL} SELECT pos, cnt FROM c ORDER BY cnt DESC, pos LIMIT 10")
def counting_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.hotspots(_users(spark, sf_dir)[0], 10)


@query(f"WITH {_USERS_SQL} SELECT pos, cnt FROM c")
def counting_raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters to bytes and back."""
    counters, spec = _users(spark, sf_dir)
    return counting.from_raw(counting.raw_counters(counters, spec, chunk=4_096), spec, chunk=4_096)


@query(f"""
WITH {_USERS_SQL}, a AS ({_at("SELECT event_id AS k, user_id AS o FROM events").replace(_h('k'), _h('o')).replace(_h('k', 2), _h('o', 2))}),
t AS (SELECT k, o, pos, row_number() OVER (PARTITION BY pos ORDER BY k) AS i FROM a), full_at AS (SELECT pos, k AS since FROM t WHERE i = 15)
SELECT a.k AS event_id, any_value(a.o) AS user_id FROM a LEFT JOIN full_at USING (pos) GROUP BY a.k HAVING bool_and(coalesce(since < a.k, false))
""")
def counting_rejected_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come when all counters of their user are saturated."""
    return counting.rejected(_t(spark, sf_dir, "events"), "user_id", "event_id", _users(spark, sf_dir)[1])


_NET_SQL = f"""sp AS ({_std('SELECT count(*) FROM orders')}), i AS ({_hits_sql("SELECT o_orderkey AS k, '' AS o FROM orders")}), d AS ({_hits_sql("SELECT o_orderkey AS k, '' AS o FROM orders WHERE o_orderstatus = 'F'")}),
net AS (SELECT i.pos, greatest(least(least(i.hits, 255) - coalesce(d.hits, 0), 255), 0) AS cnt FROM i LEFT JOIN d USING (pos))"""


def _net(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    orders = _t(spark, sf_dir, "orders")
    spec = sizing.standard(_keys(orders, "o_orderkey"), 0.01)
    return counting.apply(counting.build(orders, "o_orderkey", spec, 8), orders.where("o_orderstatus = 'F'"), "o_orderkey", spec, 8, delete=True), spec


@query(f"WITH {_NET_SQL} SELECT pos, cnt FROM net WHERE cnt > 0")
def counting_delete_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(spark, sf_dir)[0]


@query(f"""
WITH {_NET_SQL}, p AS ({_at("SELECT DISTINCT o_orderkey AS k, '' AS o FROM orders")})
SELECT k AS o_orderkey, min(coalesce(cnt, 0)) > 0 AS maybe, min(coalesce(cnt, 0)) AS least FROM p LEFT JOIN net USING (pos) GROUP BY k
""")
def counting_contains_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.contains(_t(spark, sf_dir, "orders"), "o_orderkey", *_net(spark, sf_dir))


_DELETED_AGAIN = "SELECT o_orderkey, 2 * o_orderkey AS n FROM orders WHERE o_orderstatus != 'F' UNION ALL SELECT o_orderkey, 2 * o_orderkey + 4001 FROM orders WHERE o_orderstatus != 'F'"


def _first_failure_sql(deletes: str) -> str:
    """Of rows (o_orderkey, n), deleted in the order of n: how many precede the first that fails."""
    at = _at("SELECT rank AS k, o_orderkey AS o FROM r").replace(_h("k"), _h("o")).replace(_h("k", 2), _h("o", 2))
    return f"""r AS (SELECT o_orderkey, row_number() OVER (ORDER BY n, o_orderkey) AS rank FROM ({deletes})), a AS ({at}),
t AS (SELECT pos, k, row_number() OVER (PARTITION BY pos ORDER BY k) AS i FROM a)
SELECT min(k) - 1 AS deleted_before_failure FROM t LEFT JOIN net USING (pos) WHERE i = coalesce(cnt, 0) + 1"""


@query(f"WITH {_NET_SQL}, {_first_failure_sql('SELECT o_orderkey, o_orderkey AS n FROM orders')}")
def counting_delete_until_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are deleted, the finished ones a second time."""
    return counting.first_failure(_t(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", *_net(spark, sf_dir))


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_orders = _t(spark, sf_dir, "orders").where("o_orderstatus != 'F'")
    return open_orders.selectExpr("o_orderkey", "2 * o_orderkey AS n").union(open_orders.selectExpr("o_orderkey", "2 * o_orderkey + 4001 AS n"))


@query(f"WITH {_NET_SQL}, {_first_failure_sql(_DELETED_AGAIN)}")
def counting_delete_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders are deleted twice each, so that some delete fails only for one before it."""
    return counting.first_failure(_again(spark, sf_dir), "o_orderkey", "n", *_net(spark, sf_dir))


@query(f"""
WITH {_NET_SQL}, p AS ({_at("SELECT DISTINCT c_custkey AS k, '' AS o FROM customer")})
SELECT k AS c_custkey, min(coalesce(cnt, 0)) > 0 AS can_remove FROM p LEFT JOIN net USING (pos) GROUP BY k
""")
def counting_can_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customer numbers could be taken off the filter of open order numbers."""
    return counting.can_remove(_t(spark, sf_dir, "customer"), "c_custkey", *_net(spark, sf_dir))


@query(f"""
WITH {_NET_SQL}, q AS ({_hits_sql("SELECT o_orderkey AS k, '' AS o FROM orders WHERE o_orderstatus = 'P'")})
SELECT net.pos, net.cnt - coalesce(hits, 0) AS cnt FROM net LEFT JOIN q USING (pos) WHERE net.cnt > coalesce(hits, 0)
""")
def counting_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of open orders without those in part delivered, all of which must be there."""
    counters, spec = _net(spark, sf_dir)
    partly = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return counting.remove(partly, "o_orderkey", "o_orderkey", counters, spec)


#: Rounds of enclosing: with every earlier delete applied that may succeed, and with those only that surely do.
_BATCH_SQL = f"""{_NET_SQL}, r AS (SELECT o_orderkey, n, row_number() OVER (ORDER BY n, o_orderkey) AS rank FROM ({_DELETED_AGAIN})),
a AS MATERIALIZED (SELECT k AS rank, pos, count(*) AS w, any_value(coalesce(cnt, 0)) AS c FROM ({_at("SELECT rank AS k, o_orderkey AS o FROM r").replace(_h("k"), _h("o")).replace(_h("k", 2), _h("o", 2))}) LEFT JOIN net USING (pos) GROUP BY k, pos),
s AS (
  SELECT 0 AS round, rank, NULL::BOOLEAN AS ok FROM r
  UNION ALL
  SELECT round + 1, rank, coalesce(any_value(ok), CASE WHEN bool_and(c - may >= w) THEN true WHEN bool_or(c - did < w) THEN false END) FROM (
    SELECT round, rank, pos, w, c, ok, coalesce(sum(CASE WHEN coalesce(ok, true) THEN w ELSE 0 END) OVER e, 0) AS may, coalesce(sum(CASE WHEN ok THEN w ELSE 0 END) OVER e, 0) AS did
    FROM s JOIN a USING (rank) WINDOW e AS (PARTITION BY pos ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE (SELECT count(*) FILTER (ok IS NULL) FROM s) > 0 GROUP BY round, rank),
z AS (SELECT n, o_orderkey, ok AS deleted FROM r JOIN s USING (rank) WHERE round = (SELECT max(round) FROM s))"""


@query(f"WITH RECURSIVE {_BATCH_SQL} SELECT n, o_orderkey, deleted FROM z")
def counting_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the repeated deletes succeed, one after the other."""
    return counting.delete_batch(_again(spark, sf_dir), "o_orderkey", "n", *_net(spark, sf_dir))


@query(f"WITH RECURSIVE {_BATCH_SQL} SELECT count(*) AS deletes, count(*) FILTER (deleted) AS deleted, count(*) FILTER (NOT deleted) AS failed FROM z")
def counting_delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.deleted_count(counting_delete_batch(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_BATCH_SQL}, g AS (SELECT pos, sum(w) AS gone FROM z JOIN r USING (n, o_orderkey) JOIN a USING (rank) WHERE deleted GROUP BY pos)
SELECT pos, (cnt - coalesce(gone, 0))::BIGINT AS cnt FROM net LEFT JOIN g USING (pos) WHERE cnt > coalesce(gone, 0)
""")
def counting_after_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that the deletes leave."""
    counters, spec = _net(spark, sf_dir)
    counters = checkpointed(counters)  # read before the deletes and after
    outcomes = counting.delete_batch(_again(spark, sf_dir), "o_orderkey", "n", counters, spec)
    return counting.after_deletes(counters, outcomes, "o_orderkey", spec)


_LOG_KEYS = "SELECT event_id AS k, user_id AS o FROM events WHERE user_id IS NOT NULL"
_LOG_SQL = f"""sp AS ({_std('SELECT count(DISTINCT user_id) FROM events')}),
op AS (SELECT event_id, user_id, CASE WHEN value > 20 THEN 1 ELSE -1 END AS d FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
a AS (SELECT k AS event_id, o AS user_id, pos, i, d FROM ({_at(_LOG_KEYS).replace(_h('k'), _h('o')).replace(_h('k', 2), _h('o', 2))}) JOIN op ON op.event_id = k),
l AS (SELECT pos, list(event_id ORDER BY event_id, i) AS ids, list(d ORDER BY event_id, i) AS ds FROM a GROUP BY pos),
v AS (SELECT pos, ids, ds, list_reduce(list_transform(ds, lambda d: [d]), lambda x, d: list_append(x, greatest(0, least(15, x[len(x)] + d[1]))), [0]) AS xs FROM l),
u AS MATERIALIZED (SELECT pos, unnest(ids) AS event_id, unnest(ds) AS d, unnest(xs[:len(ds)]) AS before FROM v),
h AS (SELECT pos, event_id, d, before, CASE WHEN d > 0 THEN before < 15 ELSE before > 0 END AS ok FROM u),
o AS (SELECT event_id, any_value(d) AS delta, CASE WHEN any_value(d) > 0 THEN bool_or(ok) ELSE bool_and(ok) END AS counted FROM h GROUP BY event_id)"""


def _log(spark: SparkSession, sf_dir: str) -> ledger.Ledger:
    """Events of a value above 20 put their user in, others take the user off."""
    events = _t(spark, sf_dir, "events").where("value is not null").withColumn("d", F.when(F.col("value") > 20, 1).otherwise(-1))
    return ledger.replay(events, "user_id", "event_id", "d", sizing.standard(_distinct(events, "user_id"), 0.01))


@query(f"WITH {_LOG_SQL} SELECT pos, greatest(0, least(15, xs[len(xs)])) AS cnt, coalesce(lost, 0) AS overflow FROM v LEFT JOIN (SELECT pos, count(*) AS lost FROM h WHERE d > 0 AND NOT ok GROUP BY pos) USING (pos) WHERE xs[len(xs)] > 0 OR lost > 0")
def counting_log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).counters()


@query(f"WITH {_LOG_SQL} SELECT o.event_id, user_id, delta::INT AS delta, counted FROM o JOIN op USING (event_id)")
def counting_log_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).operations()


@query(f"""
WITH {_LOG_SQL} SELECT count(*) AS operations, count(*) FILTER (delta > 0 AND counted) - count(*) FILTER (delta < 0 AND counted) AS items, count(*) FILTER (delta > 0 AND NOT counted) AS rejected_inserts,
  count(*) FILTER (delta < 0 AND NOT counted) AS failed_deletes, (SELECT count(*) FROM h WHERE d > 0 AND NOT ok) AS overflow_events FROM o
""")
def counting_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).totals()


# growing --------------------------------------------------------------------------------------


def _plan_sql(capacity: int, how: str = "ceil") -> str:
    """Slices (slice, capacity, rate, first, m, kk, groups) that all events open."""
    return f"""e AS (SELECT greatest(1, count(*)) AS arrivals FROM events), g AS (SELECT i::INT AS slice, ({capacity} * pow(2, i))::BIGINT AS capacity, 0.01 * pow(0.5, i) AS rate FROM range(36) r(i)),
t AS (SELECT *, 1 + coalesce(sum(greatest(1, {how}(capacity * 0.5))) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM g),
z AS (SELECT t.*, greatest(8, ceil(-capacity * ln(rate) / (ln(2.0) * ln(2.0))))::BIGINT AS m FROM t, e WHERE first <= arrivals),
plan AS (SELECT *, greatest(1, least(32, floor(m / capacity * ln(2.0) + 0.5)))::BIGINT AS kk, 1::BIGINT AS groups FROM z)"""


_SLICES_SQL = f"""{_plan_sql(500)}, r AS (SELECT event_id, user_id * 7919 + event_id % 50 AS k, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events),
s AS (SELECT r.event_id, r.k, plan.slice FROM r ASOF JOIN plan ON r.rank >= plan.first)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "ts", F.expr("user_id * 7919 + event_id % 50").alias("k"))


def _sliced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[Slice]]:
    """Arrivals, the same with their slices, and the slices that they open."""
    events = _arrivals(spark, sf_dir)
    n = events.count()
    plan = slice_plan(500, 0.01, n)
    return events, growing.assigned(events, ["ts", "event_id"], plan, rows=n), plan


@query(f"WITH {_SLICES_SQL} SELECT event_id, slice FROM s")
def scalable_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir)[1].select("event_id", "slice")


_WORDS_SQL = f"w AS (SELECT DISTINCT o AS slice, pos FROM ({_at('SELECT DISTINCT k, slice AS o, m, kk, groups FROM s JOIN plan USING (slice)', sizes=None)}))"
_MATCHES_SQL = f"""hit AS (SELECT p.k, p.o AS slice FROM ({_at('SELECT k, slice AS o, m, kk, groups FROM (SELECT DISTINCT k FROM s), plan', sizes=None)}) p LEFT JOIN w ON w.slice = p.o AND w.pos = p.pos
GROUP BY p.k, p.o HAVING bool_and(w.pos IS NOT NULL))"""


@query(f"WITH {_SLICES_SQL}, {_WORDS_SQL}, {_MATCHES_SQL} SELECT k, min(slice) AS slice, count(*) AS n_slices FROM hit GROUP BY k")
def scalable_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, rows, plan = _sliced(spark, sf_dir)
    return growing.provenance(events, "k", growing.build(rows, "k", plan), plan)


@query(f"WITH {_SLICES_SQL}, {_WORDS_SQL}, {_MATCHES_SQL} SELECT k, max(slice) AS slice FROM hit GROUP BY k")
def scalable_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, rows, plan = _sliced(spark, sf_dir)
    return growing.provenance(events, "k", growing.build(rows, "k", plan), plan, newest_first=True).select("k", "slice")


@query(f"WITH {_SLICES_SQL}, {_WORDS_SQL}, {_MATCHES_SQL} SELECT DISTINCT k FROM hit")
def scalable_matches_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup by joins, as for slices that are too large to broadcast: of the last slices, which have three quarters of all bits."""
    events, rows, plan = _sliced(spark, sf_dir)
    most = min(membership.BROADCAST_BYTES, sum(s.spec.memory_bytes for s in plan) // 4)
    return growing.matches(events, "k", growing.build(rows, "k", plan), plan, most).select("k").distinct()


def _batched(spark: SparkSession, sf_dir: str) -> GrowingStore:
    """A stored filter that four batches of arrivals, in their order, have filled; the second comes twice."""
    events = _arrivals(spark, sf_dir)
    cut = events.select(F.percentile_approx("ts", [0.25, 0.5, 0.75], 10_000).alias("t")).first()["t"]
    bounds = [None, *cut, None]
    batches = [events.where((F.lit(True) if a is None else F.col("ts") > a) & (F.lit(True) if z is None else F.col("ts") <= z)) for a, z in zip(bounds, bounds[1:])]
    filter_ = GrowingStore.create(spark, shared_folder(spark, "growing"), 500, 0.01)
    for number in (0, 1, 1, 2, 3):
        filter_.insert(batches[number], "k", ["ts", "event_id"], number)
    return filter_


@query(f"WITH {_SLICES_SQL}, {_WORDS_SQL}, {_MATCHES_SQL} SELECT k, min(slice) AS slice, count(*) AS n_slices FROM hit GROUP BY k")
def scalable_batches_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, one after the other, leave the filter that all arrivals at once do."""
    return _batched(spark, sf_dir).provenance(_arrivals(spark, sf_dir), "k").where("slice is not null")


_BREAKDOWN_SQL = f"""{_SLICES_SQL}, {_WORDS_SQL}, b AS (SELECT slice, capacity, rate, m, kk AS k, coalesce(n, 0) AS set_bits FROM plan LEFT JOIN (SELECT slice, count(*) AS n FROM w GROUP BY 1) USING (slice)),
f AS (SELECT *, set_bits / m AS fill_rate, pow(set_bits / m, k) AS estimated_fpr FROM b)"""


@query(
    f"WITH {_BREAKDOWN_SQL} SELECT slice, capacity, rate, m, k, set_bits, round(fill_rate, 9) AS fill_rate, round(estimated_fpr, 9) AS estimated_fpr, round(estimated_fpr / sum(estimated_fpr) OVER (), 6) AS share FROM f"
)
def scalable_fpr_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, plan = _sliced(spark, sf_dir)
    stats = growing.slice_statistics(growing.build(rows, "k", plan), plan)
    return _rounded(stats, "fill_rate", "estimated_fpr").withColumn("share", F.round("share", 6))


@query(f"""
WITH {_BREAKDOWN_SQL}, u AS (SELECT count(*) AS used, sum(pow(2.0, -rank)) AS s FROM ({"{hll}"})), v AS (SELECT used, 16384.0 - used AS z, 0.7213 / (1 + 1.079 / 16384) * 16384 * 16384 / (s + 16384 - used) AS raw FROM u),
q AS (SELECT floor(CASE WHEN used < 50 THEN used WHEN raw <= 2.5 * 16384 AND z > 0 THEN 16384 * ln(16384 / z) ELSE raw END)::BIGINT AS unique_items FROM v)
SELECT count(*) AS slices, sum(capacity)::BIGINT AS total_capacity, any_value(arrivals) AS items, any_value(unique_items) AS unique_items, sum(set_bits)::BIGINT AS set_bits, round(sum(set_bits) / sum(m), 9) AS aggregate_fill, round(arg_max(fill_rate, slice), 9) AS current_fill,
  round(1 - exp(sum(ln(1 - estimated_fpr))), 9) AS compound_fpr, round(sum(estimated_fpr), 9) AS max_fpr, 0.01::DOUBLE AS target_fpr, round((1 - exp(sum(ln(1 - estimated_fpr)))) / 0.01, 9) AS fpr_ratio,
  greatest(0, max(first) + arg_max(ceil(capacity * 0.5), slice) - 1 - any_value(arrivals))::BIGINT AS room_before_growth, 'geometric' AS growth FROM (SELECT f.*, plan.first FROM f JOIN plan USING (slice)), e, q
""".replace("{hll}", f"SELECT h % 16384 AS register, max(CASE WHEN h // 16384 = 0 THEN 47 ELSE 46 - length(ltrim(bin(h // 16384), '0')) + 1 END) AS rank FROM (SELECT {_h('k')} AS h FROM s) GROUP BY ALL"))
def scalable_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, plan = _sliced(spark, sf_dir)
    n = rows.count()
    unique = growing.unique_count(rows, "k", plan).first()[0]
    row = growing.health(growing.build(rows, "k", plan), plan, n, 0.01, unique=unique)
    return _rounded(row, "aggregate_fill", "compound_fpr", "max_fpr", "current_fill", "fpr_ratio")


@query(f"""
WITH {_plan_sql(333, 'floor')}, r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events) SELECT r.event_id, plan.slice FROM r ASOF JOIN plan ON r.rank >= plan.first
""")
def concurrent_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that open after an insert fills the last one, at half of the capacity rounded down."""
    events = _t(spark, sf_dir, "events").select("event_id", "ts")
    n = events.count()
    return growing.assigned(events, ["ts", "event_id"], slice_plan(333, 0.01, n, floor=True), rows=n).select("event_id", "slice")


@query(f"WITH {_BREAKDOWN_SQL} SELECT slice, capacity, rate, m, k, set_bits, round(fill_rate, 9) AS fill_rate, round(estimated_fpr, 9) AS estimated_fpr, round(estimated_fpr / sum(estimated_fpr) OVER (), 6) AS share FROM f")
def scalable_batches_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_batched(spark, sf_dir).statistics(), "fill_rate", "estimated_fpr").withColumn("share", F.round("share", 6))


@query(f"""
WITH {_SLICES_SQL}, {_WORDS_SQL}, {_MATCHES_SQL}, n AS (SELECT DISTINCT k FROM s)
SELECT n.k, string_agg(CASE WHEN hit.k IS NULL THEN '0' ELSE '1' END, '' ORDER BY plan.slice) AS trace FROM n CROSS JOIN plan LEFT JOIN hit ON hit.k = n.k AND hit.slice = plan.slice GROUP BY n.k
""")
def scalable_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, rows, plan = _sliced(spark, sf_dir)
    steps = growing.traced(events, "k", growing.build(rows, "k", plan), plan)
    return steps.select("k", F.array_join(F.transform("trace", lambda t: F.when(t["matched"], "1").otherwise("0")), "").alias("trace"))


_PARTED_SQL = f"sp AS ({_SIZES['partitioned']('SELECT count(*) FROM part')}), {_filter_sql('f', _ALL_PARTS, 'partitioned')}"


@query(f"""
WITH {_PARTED_SQL}, s AS ({_stats_sql('f')})
SELECT round(pow(1 - exp(-kk * n / (m * groups)), kk), 9) AS fpr_by_items, round(pow(1 - exp(-n / m), kk), 9) AS fpr_by_partition,
  CASE WHEN fill_rate < 0.01 THEN n ELSE estimated_items END AS estimated_items, fill_rate > 0.7 AS should_resize FROM s, sp
""")
def partitioned_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    n = _keys(part, "p_partkey")
    spec = sizing.partitioned(n, 0.01)
    return _rounded(membership.item_estimates(membership.build(part, "p_partkey", spec), spec, n), "fpr_by_items", "fpr_by_partition")


@query(f"""
WITH {_PARTED_SQL}, g AS (SELECT r.grp, count(f.pos) / any_value(m) AS fill FROM sp, (SELECT unnest(range((SELECT groups FROM sp))) AS grp) r LEFT JOIN f ON f.grp = r.grp GROUP BY 1)
SELECT round(avg(fill), 9) AS mean_fill, round(max(fill), 9) AS max_fill, round(pow(avg(fill), any_value(kk)), 9) AS estimated_fpr, pow(avg(fill), any_value(kk)) > 0.02 AS warning,
  CASE WHEN max(fill) < 0.7 THEN 'Healthy' WHEN max(fill) < 0.9 THEN 'Degraded' ELSE 'Critical' END AS state FROM g, sp
""")
def partitioned_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    spec = sizing.partitioned(_keys(part, "p_partkey"), 0.01)
    return _rounded(membership.group_health(membership.build(part, "p_partkey", spec), spec), "mean_fill", "max_fill", "estimated_fpr")


@query(f"""
WITH sp AS ({_SIZES['block']('SELECT count(*) FROM part')}), {_filter_sql('f', _ALL_PARTS, 'block')}, s AS ({_stats_sql('f')})
SELECT round(pow(1 - exp(-kk * n / (m * groups)), kk), 9) AS fpr_by_items, CASE WHEN fill_rate < 0.01 THEN n ELSE estimated_items END AS estimated_items FROM s, sp
""")
def block_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    n = _keys(part, "p_partkey")
    spec = sizing.blocked(n, 0.01)
    return _rounded(membership.item_estimates(membership.build(part, "p_partkey", spec), spec, n).select("fpr_by_items", "estimated_items"), "fpr_by_items")


_SHARDS = 4
_SHARDED_PLAN = f"shards AS (SELECT slice, first, m, kk, {_SHARDS}::BIGINT AS groups FROM (SELECT plan.slice, plan.first, q.m, q.kk FROM plan, LATERAL ({_std(f'ceil(plan.capacity / {_SHARDS})', 'plan.rate')}) q))"


@query(f"""
WITH {_SLICES_SQL}, {_SHARDED_PLAN}, w AS (SELECT DISTINCT o AS slice, grp, pos FROM ({_at('SELECT DISTINCT k, slice AS o, m, kk, groups FROM s JOIN shards USING (slice)', 'sharded', sizes=None)})),
n AS (SELECT slice, grp, count(*) AS n FROM w GROUP BY ALL), x AS (SELECT slice, coalesce(n, 0) AS n, pow(coalesce(n, 0) / m, kk) AS rate FROM (SELECT slice, m, kk, unnest(range(groups)) AS grp FROM shards) LEFT JOIN n USING (slice, grp))
SELECT slice, count(*) AS shards, sum(n)::BIGINT AS set_bits, round(avg(rate), 9) AS estimated_fpr, round(min(rate), 9) AS least_fpr, round(max(rate), 9) AS largest_fpr FROM x GROUP BY 1
""")
def sharded_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing slices dealt to shards, and the rates of these."""
    _, rows, plan = _sliced(spark, sf_dir)
    plan = sharded_plan(plan, _SHARDS)
    return _rounded(growing.shard_statistics(growing.build(rows, "k", plan), plan), "estimated_fpr", "least_fpr", "largest_fpr")


_MOST_ADAPTIVE = 20  # slices in the SQL, for 260 million events


def _adaptive_sql() -> str:
    """Slice after slice: the rate of each follows from how full the one before became."""
    parts = [
        "n AS (SELECT count(*) AS n FROM events)",
        "r AS MATERIALIZED (SELECT user_id * 7919 + event_id % 50 AS k, row_number() OVER (ORDER BY ts, event_id) AS rank FROM events)",
        "p0 AS (SELECT 0.01::DOUBLE AS p, 0.5::DOUBLE AS ratio)",
    ]
    first = 1
    for i in range(_MOST_ADAPTIVE):
        own, take = 500 * 2**i, 250 * 2**i
        keys = f"SELECT k, '' AS o FROM r WHERE rank BETWEEN {first} AND {first + take - 1}"
        parts.append(f"z{i} AS MATERIALIZED ({_std(str(own), f'(SELECT p FROM p{i})')})")
        parts.append(f"w{i} AS MATERIALIZED (SELECT count(DISTINCT pos) AS bits FROM ({_at(keys, sizes=f'z{i}')}))")
        parts.append(f"""p{i + 1} AS MATERIALIZED (SELECT greatest(1e-15, p * ratio2) AS p, ratio2 AS ratio FROM (
  SELECT p, CASE WHEN bits / m > 1.2 * 0.5 THEN greatest(0.9 * ratio, 0.3) WHEN bits / m < 0.8 * 0.5 THEN least(1.1 * ratio, 0.9) ELSE ratio END AS ratio2 FROM p{i}, z{i}, w{i}))""")
        first += take
    rows, first = [], 1
    for i in range(_MOST_ADAPTIVE):
        rows.append(f"SELECT {i} AS slice, {500 * 2**i}::BIGINT AS capacity, round(p, 12) AS rate, m, kk AS k, bits AS set_bits FROM p{i}, z{i}, w{i}, n WHERE n.n >= {first}")
        first += 250 * 2**i
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_adaptive_sql())
def scalable_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices whose rates tighten by how full the one before became."""
    words, plan = growing.adaptive_build(_arrivals(spark, sf_dir), "k", ["ts", "event_id"], 500, 0.01)
    stats = growing.slice_statistics(words, plan)
    return stats.select("slice", "capacity", F.round("rate", 12).alias("rate"), "m", F.col("k").cast("long").alias("k"), "set_bits")


_GROWTHS = {"constant": Growth("constant"), "geometric": Growth(), "bounded": Growth("bounded", 2.0, 4_000)}


@query(f"""
WITH n AS (SELECT greatest(1, count(*)) AS arrivals FROM events), c AS (
  SELECT g AS growth, i::INT AS slice, CASE WHEN g = 'constant' THEN 500 WHEN g = 'bounded' AND i > 0 THEN least(500 * 2.0 ** i, 4000) ELSE 500 * 2.0 ** i END::HUGEINT AS capacity, round(greatest(1e-15, 0.01 * 0.5 ** i), 12) AS rate
  FROM (SELECT unnest(['constant', 'geometric', 'bounded']) AS g), (SELECT unnest(range(64)) AS i)),
f AS (SELECT *, 1 + coalesce(sum(ceil(capacity * 0.5)) OVER (PARTITION BY growth ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c)
SELECT growth, slice, capacity::BIGINT AS capacity, rate, first::BIGINT AS first FROM f, n WHERE first <= arrivals
""")
def growth_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices that the events open, for each way of growing."""
    n = max(1, _t(spark, sf_dir, "events").count())
    rows = [(g, s.number, s.capacity, round(s.rate, 12), s.first) for g, growth in _GROWTHS.items() for s in slice_plan(500, 0.01, n, growth)]
    return spark.createDataFrame(rows, "growth string, slice int, capacity long, rate double, first long")


@query("""
WITH t AS (SELECT i, greatest(1, floor(500 * 2.0 ** i * 0.5)) AS t FROM range(40) r(i)), c AS (SELECT i, coalesce(sum(t) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
e AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, n, round(1 - exp(sum(ln(1 - 0.01 * 0.5 ** i))), 9) AS predicted_fpr FROM e JOIN c ON before < n GROUP BY event_type, n
""")
def scalable_predict_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that a growing filter would have after the events of each type."""
    found = _t(spark, sf_dir, "events").groupBy("event_type").count().collect()  # a handful of types
    return spark.createDataFrame([(t, n, round(predict_fpr(500, 0.01, n), 9)) for t, n in found], "event_type string, n long, predicted_fpr double")


# cardinality ----------------------------------------------------------------------------------

_HLL_SQL = "SELECT h % 16384 AS register, max(CASE WHEN h // 16384 = 0 THEN 47 ELSE 46 - length(ltrim(bin(h // 16384), '0')) + 1 END) AS rank FROM ({}) GROUP BY ALL"
_HLL_KEYS = f"SELECT {_h('l_partkey')} AS h FROM lineitem"


@query(_HLL_SQL.format(_HLL_KEYS))
def hll_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cardinality.registers(_t(spark, sf_dir, "lineitem"), "l_partkey").select("register", "rank")


def _estimate_sql(source: str) -> str:
    return f"""WITH r AS ({source}), s AS (SELECT count(*) AS used, sum(pow(2.0, -rank)) AS s FROM r), e AS (SELECT used, 16384.0 - used AS z, 0.7213 / (1 + 1.079 / 16384) * 16384 * 16384 / (s + 16384 - used) AS raw FROM s)
SELECT used, floor(CASE WHEN used < 50 THEN used WHEN raw <= 2.5 * 16384 AND z > 0 THEN 16384 * ln(16384 / z) WHEN raw > 4294967296 / 30.0 AND raw < 4294967296 THEN -4294967296.0 * ln(1 - raw / 4294967296) ELSE raw END)::BIGINT AS estimate FROM e"""


@query(_estimate_sql(_HLL_SQL.format(_HLL_KEYS)))
def hll_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cardinality.estimate(cardinality.registers(_t(spark, sf_dir, "lineitem"), "l_partkey"))


@query(_estimate_sql(_HLL_SQL.format(_HLL_KEYS)))
def hll_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cardinality.estimate(cardinality.merge(cardinality.registers(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")))


@query()
def hll_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cardinality.builtin_estimate(_t(spark, sf_dir, "lineitem"), "l_partkey")


@query(f"""
WITH r AS (SELECT o AS l_suppkey, h % 16384 AS register, max(CASE WHEN h // 16384 = 0 THEN 47 ELSE 46 - length(ltrim(bin(h // 16384), '0')) + 1 END) AS rank FROM (SELECT {_h('l_partkey')} AS h, l_suppkey AS o FROM lineitem) GROUP BY ALL),
s AS (SELECT l_suppkey, count(*) AS used, sum(pow(2.0, -rank)) AS s FROM r GROUP BY l_suppkey), e AS (SELECT l_suppkey, used, 16384.0 - used AS z, 0.7213 / (1 + 1.079 / 16384) * 16384 * 16384 / (s + 16384 - used) AS raw FROM s)
SELECT l_suppkey::VARCHAR AS filter_id, used, floor(CASE WHEN used < 50 THEN used WHEN raw <= 2.5 * 16384 AND z > 0 THEN 16384 * ln(16384 / z) ELSE raw END)::BIGINT AS estimate FROM e
""")
def packed_unique_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About how many parts each supplier has delivered, by a packed sketch for each."""
    return packed.estimates(packed.registers(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey"))


# packed filters -------------------------------------------------------------------------------

_SPAN = 32  # order keys that stand together
_SPANS_SQL = f"""sp AS ({_std('SELECT max(n) FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey // ' + str(_SPAN) + ')')}),
{_filter_sql('f', f"SELECT DISTINCT l_partkey AS k, (l_orderkey // {_SPAN})::VARCHAR AS o FROM lineitem")},
want AS (SELECT p_partkey AS k FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10),
need AS ({_at("SELECT k, '' AS o FROM want")}), bits AS (SELECT count(*) AS n, k FROM (SELECT DISTINCT k, grp, pos FROM need) GROUP BY k),
hit AS (SELECT f.o, k, count(*) AS n FROM (SELECT DISTINCT k, grp, pos FROM need) JOIN f USING (grp, pos) GROUP BY f.o, k),
may AS (SELECT o, count(*) AS n_keys FROM hit JOIN bits USING (k, n) GROUP BY o)"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Spec]:
    """Lines with the span of their order, a filter of parts for each span, and the ten dearest parts."""
    lines = _t(spark, sf_dir, "lineitem").withColumn("span", F.expr(f"CAST(l_orderkey div {_SPAN} AS STRING)"))
    most = lines.groupBy("span").agg(F.countDistinct("l_partkey").alias("n")).agg(F.max("n")).first()[0] or 1
    spec = sizing.standard(most, 0.01)
    want = _t(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)
    return lines, packed.build(lines, "l_partkey", "span", spec), want, spec


@query(f"WITH {_SPANS_SQL} SELECT o AS filter_id, n_keys FROM may")
def packed_spans_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of orders that may have one of the ten dearest parts; all others are passed over."""
    _, filters, want, spec = _spans(spark, sf_dir)
    return packed.holding(filters, want, "p_partkey", spec)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)")
def packed_lines_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of these parts, looked for in the spans that may have some."""
    lines, filters, want, spec = _spans(spark, sf_dir)
    spans = packed.holding(filters, want, "p_partkey", spec).select(F.col("filter_id").alias("span"))
    return lines.join(spans, "span", "left_semi").join(F.broadcast(want), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")  # ten rows


@query(f"WITH {_SPANS_SQL}, b AS (SELECT o, count(*) AS bits FROM f GROUP BY o) SELECT o AS filter_id, bits AS set_bits, round(bits / m, 9) AS fill_rate, round(pow(bits / m, kk), 9) AS estimated_fpr FROM b, sp")
def packed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, filters, _, spec = _spans(spark, sf_dir)
    return _rounded(packed.statistics(filters, spec), "fill_rate", "estimated_fpr")


# chains ---------------------------------------------------------------------------------------

_CHAIN_SQL = f"""n AS (SELECT greatest(1, count(DISTINCT user_id) // 2) AS buckets FROM events),
a AS (SELECT user_id, min(event_id) AS first, count(*) AS arrivals, {_h('user_id')} % any_value(buckets) AS bucket FROM events, n GROUP BY user_id),
c AS (SELECT bucket, user_id, row_number() OVER (PARTITION BY bucket ORDER BY first, user_id) AS slot, arrivals FROM a), k AS (SELECT *, slot <= 3 AS kept FROM c)"""


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Events, buckets for two users each, and their number."""
    events = _t(spark, sf_dir, "events")
    buckets = max(1, _distinct(events, "user_id") // 2)
    return events, chains.build(events, "user_id", "event_id", buckets), buckets


@query(f"WITH {_CHAIN_SQL} SELECT bucket, user_id, slot, arrivals, kept FROM k")
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir)[1]


@query(f"""
WITH {_CHAIN_SQL}, p AS (SELECT DISTINCT user_id * 2 AS user_id FROM events), f AS (SELECT bucket FROM k WHERE kept GROUP BY 1 HAVING count(*) >= 3)
SELECT user_id, user_id IN (SELECT user_id FROM k WHERE kept) AS stored, user_id IN (SELECT user_id FROM k WHERE kept) OR {_h('user_id')} % buckets IN (SELECT bucket FROM f) AS maybe FROM p, n
""")
def chain_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, made, buckets = _chains(spark, sf_dir)
    return chains.contains(events.select((F.col("user_id") * 2).alias("user_id")), "user_id", made, buckets)


@query(f"""
WITH {_CHAIN_SQL}, b AS (SELECT bucket, count(*) FILTER (kept) AS n, coalesce(sum(arrivals) FILTER (NOT kept), 0) AS lost, sum(arrivals) AS arrivals FROM k GROUP BY 1)
SELECT sum(b.n) AS stored, round(avg(b.n), 9) AS avg_chain, max(b.n) AS max_chain, round(count(*) / any_value(buckets), 9) AS load_factor, round(count(*) FILTER (b.n >= 3) / any_value(buckets), 9) AS estimated_fpr, sum(lost) AS discarded, sum(lost) / sum(arrivals) > 0.2 AS saturated FROM b, n
""")
def chain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, made, buckets = _chains(spark, sf_dir)
    return _rounded(chains.statistics(made, buckets), "avg_chain", "load_factor", "estimated_fpr")


# trees ----------------------------------------------------------------------------------------

_BRANCHING = (5, 4)
_TREE_ROUTE = "(" + " || '/' || ".join(f"CAST({_h(f'''CAST(c_custkey AS VARCHAR) || '#{i}' ''')} % {b} AS VARCHAR)" for i, b in enumerate(_BRANCHING)) + ")"
_TREE_KEYS = f"t AS (SELECT c_custkey, c_mktsegment, {_TREE_ROUTE} AS leaf FROM customer), n AS (SELECT c_custkey, c_mktsegment, leaf, ['', split_part(leaf, '/', 1), leaf] AS nodes FROM t)"
_NODES = (20, 4, 1)  # leaves below a node of each level


def _tree_words_sql(name: str, where: str = "true") -> str:
    levels = [
        f"SELECT {i} AS level, o AS node, pos FROM ({_at(f'SELECT c_custkey AS k, nodes[{i + 1}] AS o FROM n WHERE {where}', sizes=f'sp{i}')}) GROUP BY ALL" for i in range(
            3
        )
    ]
    return f"{name} AS ({' UNION ALL '.join(levels)})"


_TREE_SIZES = f"cap AS (SELECT greatest(1, ceil(count(*) / 16))::BIGINT AS leaf FROM customer), " + ", ".join(f"sp{i} AS ({_std(f'SELECT leaf * {x} FROM cap')})" for i, x in enumerate(_NODES))


def _tree_sql(where: str = "true") -> str:
    hits = [
        f"SELECT p.k, f.node FROM ({_at('SELECT c_custkey AS k, 0 AS o FROM n', sizes=f'sp{i}')}) p JOIN (SELECT node, pos FROM w WHERE level = {i}) f USING (pos) GROUP BY p.k, f.node HAVING count(DISTINCT i) = (SELECT kk FROM sp{i})" for i in range(
            3
        )
    ]
    return f"{_TREE_KEYS}, {_TREE_SIZES}, {_tree_words_sql('w', where)}, " + ", ".join(f"h{i} AS ({x})" for i, x in enumerate(hits))


_LOCATE = "SELECT h2.k AS c_custkey, h2.node FROM h2 JOIN h1 ON h1.k = h2.k AND h1.node = split_part(h2.node, '/', 1)"


def _plan(spark: SparkSession, sf_dir: str) -> TreePlan:
    return TreePlan(max(1, -(-_t(spark, sf_dir, "customer").count() // 16)), 0.01, _BRANCHING)


def _tree(spark: SparkSession, sf_dir: str, where: str = "true") -> tuple[DataFrame, DataFrame, TreePlan]:
    plan = _plan(spark, sf_dir)
    rows = _t(spark, sf_dir, "customer").where(where).select("c_custkey", trees.route(F.col("c_custkey"), plan).alias("path"))
    return rows, trees.build(rows, "c_custkey", "path", plan), plan


@query(f"WITH {_TREE_KEYS} SELECT c_custkey, leaf FROM t")
def tree_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, plan = _tree(spark, sf_dir)
    return rows.select("c_custkey", trees.node(F.col("path"), plan.depth).alias("leaf"))


@query(f"WITH {_tree_sql()} {_LOCATE} JOIN h0 ON h0.k = h2.k")
def tree_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return trees.locate(rows, "c_custkey", words, plan)


@query(f"""
WITH {_tree_sql("c_mktsegment = 'BUILDING'")}, l AS ({_LOCATE} JOIN h0 ON h0.k = h2.k),
c AS (SELECT n.c_custkey, count(DISTINCT h1.node) AS n1, (SELECT count(*) FROM l WHERE l.c_custkey = n.c_custkey) AS n2 FROM n LEFT JOIN h0 ON h0.k = n.c_custkey LEFT JOIN h1 ON h1.k = h0.k GROUP BY n.c_custkey)
SELECT c.c_custkey, l.node AS path, (CASE WHEN h0.k IS NULL THEN 0 ELSE {_BRANCHING[0]} + {_BRANCHING[1] - 1} * n1 - n2 END)::INT AS pruned FROM c LEFT JOIN l USING (c_custkey) LEFT JOIN h0 ON h0.k = c.c_custkey
""")
def tree_locate_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, looked for in a tree of some by a table function in SQL, with the nodes that it passed over."""
    _, words, plan = _tree(spark, sf_dir, "c_mktsegment = 'BUILDING'")
    trees.register_locate(spark, "sketch_locate", words, plan)
    customers = _t(spark, sf_dir, "customer")
    return spark.sql("SELECT c_custkey, l.path, l.pruned FROM {customers}, LATERAL sketch_locate(CAST(c_custkey AS STRING)) AS l", customers=customers)


@query(f"WITH {_tree_sql()} {_LOCATE} WHERE h1.node = '2'")
def tree_locate_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return trees.locate(rows, "c_custkey", words, plan, (2,))


@query(f"WITH {_tree_sql()} SELECT h2.k AS c_custkey FROM h2 JOIN h1 ON h1.k = h2.k AND h1.node = '3' JOIN h0 ON h0.k = h2.k WHERE h2.node = '3/1'")
def tree_contains_in_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return trees.contains_in(rows, "c_custkey", words, plan, (3, 1))


@query(f"WITH {_tree_sql()} {_LOCATE} JOIN h0 ON h0.k = h2.k WHERE h1.node != '2'")
def tree_clear_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return trees.locate(rows, "c_custkey", trees.clear_subtree(words, (2,)), plan)


@query(f"""
WITH {_TREE_KEYS}, c AS (SELECT 0 AS level, '' AS node, count(*) FILTER (nodes[2] != '2') AS items FROM n UNION ALL SELECT 1, nodes[2], count(*) FROM n WHERE nodes[2] != '2' GROUP BY 2 UNION ALL SELECT 2, leaf, count(*) FROM n WHERE nodes[2] != '2' GROUP BY 2)
SELECT level, node, items FROM c
""")
def tree_counts_after_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, plan = _tree(spark, sf_dir)
    return trees.counts_after_clear(trees.counts(rows, "path", plan), (2,))


_SEGMENTS = ("c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_mktsegment IN ('MACHINERY', 'FURNITURE', 'AUTOMOBILE')")


def _tree_pair(how: str, keep: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (_, a, plan), (_, b, _) = (_tree(spark, sf_dir, where) for where in _SEGMENTS)
        words = getattr(trees, how)(a, b, plan, plan)
        return words.groupBy("level", F.col("filter_id").alias("node")).agg(F.sum(F.bit_count("bits").cast("long")).alias("set_bits"))

    run.__name__ = f"tree_{how}"
    query(
        f"WITH {_TREE_KEYS}, {_TREE_SIZES}, {_tree_words_sql('x', _SEGMENTS[0])}, {_tree_words_sql('y', _SEGMENTS[1])} SELECT level, node, count(*) AS set_bits FROM (SELECT * FROM x {keep} SELECT * FROM y) GROUP BY ALL"
    )(run)


_tree_pair("union", "UNION")
_tree_pair("intersect", "INTERSECT")


@query(f"WITH {_tree_sql()} SELECT count(*) > 0 AS \"any\" FROM h0 WHERE k IN (SELECT c_custkey FROM customer)")
def tree_query_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return trees.query_any(rows, "c_custkey", words, plan)


@query(f"""
WITH {_tree_sql()}, c AS (SELECT 0 AS level, 1 AS used_nodes, count(*) AS items FROM n UNION ALL SELECT 1, count(DISTINCT nodes[2]), count(*) FROM n UNION ALL SELECT 2, count(DISTINCT nodes[3]), count(*) FROM n),
b AS (SELECT level, count(*) AS set_bits FROM w GROUP BY 1), p AS (SELECT 0 AS level, 1 AS nodes, m FROM sp0 UNION ALL SELECT 1, 5, m FROM sp1 UNION ALL SELECT 2, 20, m FROM sp2)
SELECT level, nodes, used_nodes, items, set_bits, round(set_bits / (m * nodes), 9) AS fill_rate, round(items / (leaf * 20), 9) AS avg_load FROM p JOIN c USING (level) JOIN b USING (level), cap
""")
def tree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return _rounded(trees.statistics(words, trees.counts(rows, "path", plan), plan), "fill_rate", "avg_load")


@query(f"""
WITH {_tree_sql()}, b AS (SELECT level, count(*) AS set_bits FROM w GROUP BY 1), p AS (SELECT 0 AS level, 1 AS nodes, m FROM sp0 UNION ALL SELECT 1, 5, m FROM sp1 UNION ALL SELECT 2, 20, m FROM sp2),
s AS (SELECT level, set_bits / (m * nodes) AS fill FROM p JOIN b USING (level)), i AS (SELECT count(*) AS items FROM n)
SELECT round(max(fill), 9) AS max_fill, arg_max(level, fill) AS fullest_level, any_value(items) AS items, round(any_value(items) / any_value(leaf * 20), 9) AS leaf_load,
  CASE WHEN any_value(items) / any_value(leaf * 20) > 0.9 THEN 'Critical' WHEN any_value(items) / any_value(leaf * 20) > 0.7 THEN 'Degraded' ELSE 'Healthy' END AS state FROM s, i, cap
""")
def tree_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return _rounded(trees.health(trees.statistics(words, trees.counts(rows, "path", plan), plan)), "max_fill", "leaf_load")


# reports and stores ---------------------------------------------------------------------------

_LOOSE_SQL = f"sp AS ({_std(f'SELECT count(k) FROM ({_URGENT_KEYS})', 0.05)}), {_filter_sql('f', _URGENT_KEYS)}"
_LABELLED = f"WITH {_LOOSE_SQL}, {_probe_sql('hit', 'SELECT o_orderkey AS k FROM orders', 'f')}, l AS (SELECT o_orderkey, o_orderstatus, maybe, o_orderpriority = '1-URGENT' AS actual FROM orders JOIN hit ON k = o_orderkey)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what a loose filter of urgent ones says, and what is true."""
    return membership.probe(
        _t(spark, sf_dir, "orders"),
        "o_orderkey",
        *_urgent(spark, sf_dir, 0.05),
    ).withColumn("actual", F.col("o_orderpriority") == "1-URGENT")


@query(f"""
{_LABELLED}, c AS (SELECT count(*) AS probes, count(*) FILTER (maybe) AS positives, count(*) FILTER (maybe AND NOT actual) AS false_positives, count(*) FILTER (NOT maybe AND actual) AS false_negatives, count(*) FILTER (NOT actual) AS absent FROM l)
SELECT *, round(false_positives / positives, 9) AS discovery_rate, round(false_positives / absent, 9) AS fpr, round((false_positives / absent - 0.05) / 0.05 * 100, 6) AS deviation_percent, probes >= 100 AS enough, false_positives / absent > 0.075 AS alert FROM c
""")
def fp_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.fp_tracker(_labelled(spark, sf_dir), 0.05)
    return _rounded(out, "discovery_rate", "fpr").withColumn("deviation_percent", F.round("deviation_percent", 6))


@query(
    f"{_LABELLED} SELECT o_orderkey, round(avg(maybe::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS window_fpr FROM l WHERE NOT actual"
)
def sliding_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sliding_fpr(_labelled(spark, sf_dir), "o_orderkey", 100).select("o_orderkey", F.round("window_fpr", 9).alias("window_fpr"))


@query(
    "SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p99_9 FROM events"
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latency(_t(spark, sf_dir, "events"), "value", accuracy=1_000_000).withColumn("mean", F.round("mean", 6))


_BUCKET = "least(floor((ln(greatest(least(value, 60.0), 1e-9)) - ln(1e-9)) / (ln(60.0) - ln(1e-9)) * 64), 63)::INT"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_histogram(_t(spark, sf_dir, "events"), "value")


def _from_histogram_sql() -> str:
    at = lambda p: f"round(min(CASE WHEN upto >= {p} * total AND upto - n < {p} * total THEN exp(ln(1e-9) + (bucket + ({p} * total - (upto - n)) / n) * (ln(60.0) - ln(1e-9)) / 64) END), 6)"
    return f"""WITH h AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), c AS (SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM h)
SELECT max(total) AS n, {', '.join(f'{at(p)} AS {c}' for p, c in ((0.5, 'p50'), (0.9, 'p90'), (0.95, 'p95'), (0.99, 'p99'), (0.999, 'p99_9')))} FROM c"""


@query(_from_histogram_sql())
def latency_from_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.from_histogram(reports.log_histogram(_t(spark, sf_dir, "events"), "value"))
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p95", "p99", "p99_9")})


_GAUGES = " || chr(10) || ".join(f"'# TYPE filter_{c} gauge' || chr(10) || 'filter_{c} ' || {c}::VARCHAR" for c in ("set_bits", "fill_rate", "estimated_fpr", "estimated_items"))


@query(f"WITH {_URGENT_SQL}, s AS ({_stats_sql('f')}) SELECT {_GAUGES} AS text FROM s")
def stats_as_prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = _rounded(membership.statistics(*_urgent(spark, sf_dir)), "fill_rate", "estimated_fpr")
    return reports.to_prometheus(row.drop("saturated"), "filter")


@query(f"WITH {_LOTS_SQL} SELECT o AS filter_id, pos FROM f")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, spec = _lots(spark, sf_dir)
    return membership.set_positions(store.from_json(store.to_json(words, spec))).select(F.col("filter_id").cast("int").alias("filter_id"), "pos")


@query(f"WITH {_URGENT_SQL} SELECT pos FROM f")
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter to bytes and back."""
    words, spec = _urgent(spark, sf_dir)
    return membership.set_positions(store.from_bytes(store.to_bytes(words, spec, chunk=64), spec, chunk=64)).select("pos")


# uses -----------------------------------------------------------------------------------------

_PAIR = "length(CAST(user_id AS VARCHAR)) || ':' || user_id || length(CAST(hour(ts) AS VARCHAR)) || ':' || hour(ts)"
_CLICKS = f"SELECT {_PAIR} AS k, '' AS o FROM events WHERE event_type = 'click'"


@query(
    f"WITH sp AS ({_std(f'SELECT count(k) FROM ({_CLICKS})', 0.005)}), {_filter_sql('f', _CLICKS)}, {_probe_sql('hit', f'SELECT {_PAIR} AS k FROM events', 'f')} SELECT event_id, maybe FROM (SELECT event_id, {_PAIR} AS k FROM events) JOIN hit USING (k)"
)
def rate_limit_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events fall in an hour of the day in which their user has clicked."""
    events = _t(spark, sf_dir, "events")
    key = composite(F.col("user_id"), F.hour("ts"))
    clicks = events.where("event_type = 'click'")
    spec = sizing.standard(_keys(clicks, key), 0.005)
    return membership.probe(events, key, membership.build(clicks, key, spec), spec).select("event_id", "maybe")


@query(f"""
WITH sp AS ({_std('SELECT count(url) FROM pages', 0.05)}), a AS (SELECT url AS k, min(page_id) AS o FROM pages WHERE url IS NOT NULL GROUP BY 1), p AS ({_at('SELECT k, o FROM a')}), s AS (SELECT pos, min(o) AS since FROM p GROUP BY 1)
SELECT o AS page_id FROM p JOIN s USING (pos) GROUP BY k, o HAVING NOT bool_and(since < o)
""")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a crawl in the order of page_id still has to fetch: check, then insert, of every URL."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    return membership.first_seen(pages, "url", "page_id", sizing.standard(_keys(pages, "url"), 0.05)).select("page_id")


# stores and variants --------------------------------------------------------------------------


@query(f"WITH {_URGENT_SQL} SELECT pos FROM f")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that is saved and loaded, with its spec compared."""
    words, spec = _urgent(spark, sf_dir)
    path = shared_folder(spark, "filter")
    store.save(words, spec, path)
    return membership.set_positions(store.load(spark, path, spec)[0]).select("pos")


@query(f"WITH {_USERS_SQL} SELECT pos, cnt FROM c")
def counting_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters, spec = _users(spark, sf_dir)
    path = shared_folder(spark, "counters")
    store.save_counting(counters, spec, 4, path)
    return store.load_counting(spark, path)[0]


@query(f"WITH {_BREAKDOWN_SQL} SELECT slice, set_bits FROM b")
def scalable_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that are saved and loaded with their plan."""
    _, rows, plan = _sliced(spark, sf_dir)
    path = shared_folder(spark, "slices")
    store.save_growing(growing.build(rows, "k", plan), plan, path)
    return growing.slice_statistics(*store.load_growing(spark, path)).select("slice", "set_bits")


@query(f"WITH {_tree_sql()} SELECT level, node, count(*) AS set_bits FROM w GROUP BY level, node")
def tree_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, words, plan = _tree(spark, sf_dir)
    path = shared_folder(spark, "tree")
    store.save_tree(words, plan, path)
    back, _ = store.load_tree(spark, path)
    return back.groupBy("level", F.col("filter_id").alias("node")).agg(F.sum(F.bit_count("bits").cast("long")).alias("set_bits"))


@query(f"WITH {_CHAIN_SQL} SELECT bucket, slot, user_id FROM k WHERE kept")
def chain_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.elements(_chains(spark, sf_dir)[1], "user_id")


_SEEDED = "md5('7|' || CAST(k AS VARCHAR))"
_SEEDED_AT = lambda keys: _at(keys).replace("md5(CAST(k AS VARCHAR))", _SEEDED)


@query(f"""
WITH sp AS ({_std(f'SELECT count(k) FROM ({_URGENT_KEYS})')}), f AS (SELECT DISTINCT pos FROM ({_SEEDED_AT(_URGENT_KEYS)})),
p AS ({_SEEDED_AT("SELECT DISTINCT o_orderkey AS k, '' AS o FROM orders")})
SELECT k AS o_orderkey, bool_and(f.pos IS NOT NULL) AS maybe FROM p LEFT JOIN f USING (pos) GROUP BY k
""")
def seeded_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter whose hashes have a seed of their own, probed with all orders."""
    orders = _t(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    spec = sizing.standard(_keys(urgent, "o_orderkey"), 0.01, seed=7)
    return membership.probe(orders.select("o_orderkey"), "o_orderkey", membership.build(urgent, "o_orderkey", spec), spec)


@query("""
SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey
""")
def fast_prefiltered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of urgent orders: a filter of the fast profile goes before the join, which takes off what it passed in error."""
    urgent = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    spec = sizing.standard(_keys(urgent, "o_orderkey"), 0.01, profile="fast")
    lines = membership.semi_join(_t(spark, sf_dir, "lineitem"), "l_orderkey", membership.build(urgent, "o_orderkey", spec), spec)
    return lines.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query(f"WITH {_tree_sql()} SELECT count(*) / (any_value(cap.leaf) * 20) > 0.7 AS needs_resize FROM n, cap")
def tree_needs_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words, plan = _tree(spark, sf_dir)
    return trees.needs_resize(trees.statistics(words, trees.counts(rows, "path", plan), plan))


@query(f"""
WITH {_tree_sql()}, cap2 AS (SELECT 2 * leaf AS leaf FROM cap), {", ".join(f"rs{i} AS ({_std(f'SELECT leaf * {x} FROM cap2')})" for i, x in enumerate(_NODES))},
r AS ({" UNION ALL ".join(f"SELECT {i} AS level, o AS node, pos FROM ({_at(f'SELECT c_custkey AS k, nodes[{i + 1}] AS o FROM n', sizes=f'rs{i}')}) GROUP BY ALL" for i in range(3))})
SELECT level, node, count(*) AS set_bits FROM r GROUP BY level, node
""")
def tree_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree for twice as many customers a leaf."""
    rows, _, plan = _tree(spark, sf_dir)
    words, _ = trees.resized(rows, "c_custkey", "path", plan, 2 * plan.capacity)
    return words.groupBy("level", F.col("filter_id").alias("node")).agg(F.sum(F.bit_count("bits").cast("long")).alias("set_bits"))


# streams --------------------------------------------------------------------------------------

_STREAM_SQL = f"""sp AS ({_SIZES["block"]('SELECT count(DISTINCT user_id) FROM events')}),
op AS (SELECT event_id, ts, CASE WHEN value > 20 THEN 1 ELSE -1 END AS d FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
a AS ({_at(_LOG_KEYS, "block").replace(_h('k'), _h('o')).replace(_h('k', 2), _h('o', 2))}),
e AS (SELECT k AS event_id, any_value(grp) AS grp, any_value(ts) AS ts, list_prepend(any_value(d)::BIGINT, list(pos ORDER BY i)) AS x FROM a JOIN op ON op.event_id = k GROUP BY k),
l AS (SELECT grp, list(event_id ORDER BY ts, event_id) AS ids, list(x ORDER BY ts, event_id) AS xs FROM e GROUP BY grp),
r AS MATERIALIZED (SELECT grp, ids, list_reduce(xs, lambda s, x: list_append(
  list_concat(list_transform(s[1:512], lambda c, i: CASE
    WHEN NOT list_contains(x[2:], i - 1) THEN c WHEN x[1] > 0 THEN least(255, c + 1)
    WHEN list_min(list_transform(x[2:], lambda p: s[p + 1])) > 0 THEN c - 1 ELSE c END), s[513:]),
  CASE WHEN x[1] > 0 THEN 100 * (list_min(list_transform(x[2:], lambda p: s[p + 1])) < 255)::BIGINT + len(list_filter(x[2:], lambda p: s[p + 1] >= 255))
    ELSE 100 * (list_min(list_transform(x[2:], lambda p: s[p + 1])) > 0)::BIGINT END), list_transform(range(512), lambda i: 0::BIGINT)) AS s FROM l)"""


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The log of events as a stream that a counting filter in the state store follows to its end: its outcomes, and its checkpoint."""
    spec = sizing.blocked(_distinct(_t(spark, sf_dir, "events"), "user_id"), 0.01)
    folder, before = shared_folder(spark, "stream"), spark.conf.get(counting_state.PROVIDER, None)
    spark.conf.set(counting_state.PROVIDER, counting_state.ROCKSDB)
    try:
        events = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.[p]arquet")  # a pattern, as the table may be one file
        log = events.where("value is not null").withColumn("d", F.when(F.col("value") > 20, 1).otherwise(-1))
        out = counting_state.operations(log, "user_id", "event_id", "ts", "d", spec)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(counting_state.PROVIDER)
        else:
            spark.conf.set(counting_state.PROVIDER, before)
    return spark.read.schema("n long, ts timestamp, delta int, ok boolean, overflow int").parquet(f"{folder}/out"), f"{folder}/checkpoint"


@query(f"""
WITH {_STREAM_SQL}, o AS (SELECT unnest(ids) AS n, unnest(s[513:]) AS c FROM r)
SELECT n, d::INT AS delta, c >= 100 AS ok, (c % 100)::INT AS overflow FROM o JOIN op ON op.event_id = n
""")
def counting_stream_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts and verified deletes of a stream, one after the other, and whether each succeeded."""
    return _streamed(spark, sf_dir)[0].drop("ts")


@query(f"WITH {_STREAM_SQL}, c AS (SELECT grp, unnest(s[:512]) AS cnt, unnest(range(512)) AS pos FROM r) SELECT grp, pos::INT AS pos, cnt FROM c WHERE cnt > 0")
def counting_stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that the stream leaves in the state store."""
    return counting_state.counters(spark, _streamed(spark, sf_dir)[1])
