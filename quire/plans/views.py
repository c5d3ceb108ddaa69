"""Input views that the test tables don't have ready: the same expressions serve both engines.

Each view is a SELECT list over a FROM clause that Spark SQL and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(key: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {cases} END)"


def _words(key: str, *values: str) -> str:
    return _pick(key, *[f"'{v}'" for v in values])


def _pad(x: str, n: int) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


_K = "o_orderkey"
_MONTHS = "January February March April May June July August September October November December".split()
_Y, _M, _D = f"cast(2015 + {_K} % 10 as string)", f"(1 + {_K} % 12)", f"(1 + {_K} % 28)"
_LONG, _SHORT = _words(f"{_K} % 12", *_MONTHS), _words(f"{_K} % 12", *[m[:3] for m in _MONTHS])
_DATE = _pick(
    _K,
    f"{_Y} || '-' || {_pad(_M, 2)} || '-' || {_pad(_D, 2)}",
    f"{_pad(_M, 2)} || '/' || {_pad(_D, 2)} || '/' || {_Y}",
    f"{_LONG} || ' ' || cast({_D} as string) || ', ' || {_Y}",
    f"{_SHORT} || ' ' || cast({_D} as string) || ', ' || {_Y}",
    f"cast({_D} as string) || ' ' || {_LONG} || ' ' || {_Y}",
    f"{_pad(_D, 2)} || '.' || {_pad(_M, 2)} || '.' || {_Y}",
    f"{_Y} || '/13/45'",
)
_FIRST = _words(f"({_K} + o_custkey)", "John", "Mary", "Peter", "Alice", "Robert", "Laura", "The")
_LAST = _words("o_custkey", "Smith", "Jones", "Miller", "Brown", "Taylor")
_CENTS = "cast(floor(o_totalprice * 100) as bigint)"
_DOLLARS = f"cast(({_CENTS} - {_CENTS} % 100) / 100 as bigint)"
_THOUSANDS = f"cast(({_DOLLARS} - {_DOLLARS} % 1000) / 1000 as bigint)"
_MONEY = f"CASE WHEN {_DOLLARS} >= 1000 THEN cast({_THOUSANDS} as string) || ',' || {_pad(f'{_DOLLARS} % 1000', 3)} ELSE cast({_DOLLARS} as string) END || '.' || {_pad(f'{_CENTS} % 100', 2)}"
_A, _B, _C = f"(200 + {_K} % 700)", f"(100 + o_custkey % 900)", f"{_pad(f'{_K} % 10000', 4)}"
_PHONE = _pick(
    _K,
    f"'+1 ' || cast({_A} as string) || ' ' || cast({_B} as string) || ' ' || {_C}",
    f"'(' || cast({_A} as string) || ') ' || cast({_B} as string) || '-' || {_C}",
    f"cast({_A} as string) || '-' || cast({_B} as string) || '-' || {_C}",
    f"cast({_A} as string) || '.' || cast({_B} as string) || '.' || {_C}",
    f"cast({_A} as string) || ' ' || cast({_B} as string) || ' ' || {_C}",
)
_KIND = _words(
    _K,
    "invoice total due payment terms subtotal tax",
    "agreement parties hereby whereas terms and conditions contract",
    "dear sincerely regards yours truly",
    "report summary findings analysis conclusion quarterly",
    "patient diagnosis treatment prescription doctor",
    "abstract introduction methodology references university",
    "please fill in the form name address signature",
    "resume experience education skills employment",
    "plain words of no class at all",
    "court plaintiff defendant attorney",
    "manual instructions chapter warning",
)
_NL = "chr(10)"
#: doc_id, page, text: one business-like page for each order.
BIZ_SELECT = f"""o_orderkey AS doc_id, 1 + cast(o_orderkey % 2 as int) AS page,
 'Invoice #INV-' || cast({_K} as string) || {_NL} || 'Date: ' || {_DATE} || {_NL} || 'Bill to: ' || {_words(_K, 'Mr. ', 'Dr. ', '', 'Ms ')} || {_FIRST} || ' ' || {_LAST} || {_NL}
 || 'Mail: ' || lower({_FIRST}) || '.' || cast(o_custkey as string) || '@mail' || cast({_K} % 7 as string) || '.example.' || {_words(_K, 'com', 'org', 'io')} || {_NL}
 || 'Phone: ' || {_PHONE} || {_NL} || 'Total: ' || {_words(_K, '$', 'EUR ', '£', 'USD ')} || {_MONEY} || {_NL}
 || 'Ship to: ' || cast(1 + {_K} % 999 as string) || ' Main Street, ' || {_words('o_custkey', 'Boston, MA', 'Austin, TX', 'Miami, FL')} || ' ' || {_pad(f'{_K} % 100000', 5)} || {_NL}
 || 'See ' || {_words(_K, 'https://www.shop', 'http://shop', 'www.shop')} || cast(o_custkey % 50 as string) || {_words(_K, '.com/item/', '.net/', '.zzz/')} || cast({_K} as string) || {_NL}
 || 'SSN ' || {_pad(f'{_K} % 1000', 3)} || '-' || {_pad('o_custkey % 100', 2)} || '-' || {_pad(f'{_K} % 10000', 4)} || ' Order: PO-' || cast(10000 + {_K} as string) || ' Account: AC' || {_pad('o_custkey', 6)} || {_NL}
 || {_KIND} || {_NL} || CASE WHEN {_K} % 5 = 0 THEN 'Signature: ________' || {_NL} || '1. first point' || {_NL} || '2. second point' || {_NL} || 'a | b | c' || {_NL} || 'd | e | f' ELSE 'Thank you for your order.' END AS text"""
BIZ = f"SELECT {BIZ_SELECT} FROM orders"


#: Pages of text work in one task, and forms.
PAGES_A_TASK, FORMS_A_TASK = 50_000, 10_000


def _spread(rows: DataFrame, key: str, a_task: int) -> DataFrame:
    """The rows of a small file dealt by key to as many tasks as the work on what they grow to needs: its few splits would be as many long tasks."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // a_task))
    return rows.repartition(tasks, key) if rows.rdd.getNumPartitions() < tasks else rows


def biz_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _spread(orders, "o_orderkey", PAGES_A_TASK).selectExpr(*_list(BIZ_SELECT))


def _list(select: str) -> list[str]:
    """The expressions of a SELECT list, split at top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(select):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(select[start:i])
                start = i + 1
    return [x.strip() for x in [*out, select[start:]]]


#: doc_id, page, text: documents cut into pages of 1000 characters.
DOC_PAGES = """SELECT doc_id, page, substring(text, (page - 1) * 1000 + 1, 1000) AS text FROM (
 SELECT doc_id, text, unnest(generate_series(1, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS page FROM documents)"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id", "text", "explode(sequence(1L, greatest(1L, cast(ceil(length(text) / 1000.0D) as bigint)))) AS page")
    return docs.selectExpr("doc_id", "page", "substring(text, cast((page - 1) * 1000 + 1 as int), 1000) AS text")


_LINE = "(CASE WHEN k >= 5 THEN 0 ELSE line END)"
_COL = "(k % 5)"
#: doc_id, page, item_idx, str, x, y, width, height, font_size, font_name, has_eol: five items for each order line, and a header line.
_ITEMS = f"""o AS doc_id, CASE WHEN {_LINE} >= 5 THEN 2 ELSE 1 END AS page, cast(5 * {_LINE} + {_COL} as int) AS item_idx,
 CASE WHEN k >= 5 THEN {_words(_COL, 'No', 'Item', 'Qty', 'Price', 'Status')} WHEN (pk + {_COL}) % 7 = 0 THEN ' ' ELSE {_pick(_COL, 'cast(line as string)', "'Part ' || cast(pk as string)", 'cast(pk % 50 as string)', "cast(sk as string) || '.' || cast(10 + pk % 90 as string)", "'open, ' || cast(sk % 9 as string)")} END AS str,
 cast(50 + 100 * {_COL} + pk % 3 as double) AS x, cast(700 - 20 * {_LINE} + (sk + {_COL}) % 3 as double) AS y, cast(60 + 39 * (pk % 2) as double) AS width, cast(10 as double) AS height,
 cast(CASE WHEN {_LINE} % 3 = 0 THEN 18 WHEN line % 3 = 1 AND pk % 5 = 0 THEN 14 ELSE 11 END as double) AS font_size, CASE WHEN {_LINE} % 3 = 0 THEN 'Sans-Bold' ELSE 'Sans' END AS font_name, {_COL} = 4 AS has_eol"""
_ORDER_LINES = "SELECT l_orderkey AS o, l_linenumber AS line, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber"
TEXT_ITEMS = f"SELECT {_ITEMS} FROM (SELECT *, unnest(range(0, CASE WHEN line = 1 THEN 10 ELSE 5 END)) AS k FROM ({_ORDER_LINES}))"


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg({"l_partkey": "min", "l_suppkey": "min"})
    lines = lines.selectExpr("l_orderkey AS o", "l_linenumber AS line", "`min(l_partkey)` AS pk", "`min(l_suppkey)` AS sk")
    return lines.selectExpr("*", "explode(sequence(0L, if(line = 1, 9L, 4L))) AS k").selectExpr(*_list(_ITEMS))


#: doc_id, page, item_idx, str, x, y, width, height: the items of one form for each customer.
_FORM = f"""c AS doc_id, CASE WHEN k >= 8 AND c % 3 = 0 THEN 2 ELSE 1 END AS page, cast(k as int) AS item_idx,
 {_pick('k', "'Name:'", "'________'", "'Email Address *'", "'__________'", "'[ ]'", "'I agree'", "'Date of birth:'", "'Phone:'", "CASE WHEN c % 2 = 0 THEN 'Signature' ELSE 'Total (required)' END", "'-----'", "'Due * '", "'Amount:'")} AS str,
 cast({_pick('k', '50', '120 + c % 20', '50', '160', '50 + c % 7', '75', '50 + c % 5', '300 + (c * 7) % 300', '55', '50', '400', '50')} as double) AS x,
 cast({_pick('k', '700', '700 + c % 3', '660', '661', '620', '620', '580', '545', '510', '480 - c % 4', '440', '300')} as double) AS y,
 cast({_pick('k', '40', '150', '90', '200', '10', '40', '80', '40', '60', '100 + c % 11', '30', '50')} as double) AS width, cast({_pick('k', '12', '12', '12', '12', '10', '10', '12', '12', '12', '3', '12', '12')} as double) AS height"""
FORM_ITEMS = f"SELECT {_FORM} FROM (SELECT c_custkey AS c, unnest(range(0, 12)) AS k FROM customer)"
FORM_PAGES = "SELECT c_custkey AS doc_id, unnest([1, 2]) AS page, CAST(600 + c_custkey % 13 AS DOUBLE) AS page_width FROM customer"


def form_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _spread(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", FORMS_A_TASK)
    return forms.selectExpr("c_custkey AS c", "explode(sequence(0L, 11L)) AS k").selectExpr(*_list(_FORM))


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "explode(array(1, 2)) AS page", "cast(600 + c_custkey % 13 as double) AS page_width")
