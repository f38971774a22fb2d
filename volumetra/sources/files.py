"""File sources and sinks: delimited text, vendor payloads, the Parquet lake."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volumetra.sources.bars import OHLCV, validate

# Header words of each column, English and German, the preferred first.
SYNONYMS = {
    "date": ("date", "datum", "day", "tag", "zeit", "time"),
    "open": ("open", "erster", "eröffnung", "eroeffnung", "first", "open price"),
    "high": ("high", "hoch", "höchst", "hoechst", "max"),
    "low": ("low", "tief", "tiefst", "niedrig", "min"),
    "close": ("close", "schluss", "schlusskurs", "closing", "last", "letzter", "adj close"),
    "volume": ("volume", "stück", "stücke", "stueck", "stuecke", "stk", "units", "umsatz", "volumen", "vol"),
}


def resolve_columns(header: list[str], explicit: dict[str, str] | None = None) -> dict[str, int]:
    """Canonical column to position in the header; an explicit name wins over synonyms, an earlier synonym over a later one."""
    plain = [re.sub(r'[<>"]', "", h).strip().lower() for h in header]
    asked = {k.lower(): v for k, v in (explicit or {}).items()}
    out = {}
    for name, words in SYNONYMS.items():
        ranked = sorted((words.index(h), i) for i, h in enumerate(plain) if h in words)
        if asked.get(name) in header:
            out[name] = header.index(asked[name])
        elif ranked:
            out[name] = ranked[0][1]
    if absent := [c for c in SYNONYMS if c not in out and c != "volume"]:
        raise ValueError(f"no column for {absent} in {header}")
    return out


#: Decimal and thousands marks of a separator.
MARKS = {";": (",", "."), ",": (".", "")}


def layout(header: str) -> tuple[str, str, str]:
    """(separator, decimal mark, thousands mark): the separator is what stands oftener in the header, semicolons on a tie."""
    semicolons = header.count(";")
    separator = ";" if semicolons and semicolons >= header.count(",") else ","
    return separator, *MARKS[separator]


def number(c: Column, decimal: str, thousands: str) -> Column:
    if thousands:
        c = F.replace(c, F.lit(thousands), F.lit(""))
    if decimal != ".":
        c = F.replace(c, F.lit(decimal), F.lit("."))
    return F.trim(c).try_cast("double")


def date(c: Column, dayfirst: bool) -> Column:
    """The first format that fits; what fits none is null."""
    c = F.trim(c)
    first, second = ["dd.MM.yyyy", "dd.MM.yy", "dd/MM/yyyy"], ["MM/dd/yyyy"]
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", *(first if dayfirst else second + first[:2])]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def parse_lines(lines: DataFrame, header: str, symbol: Column | None = None, column_map: dict[str, str] | None = None) -> DataFrame:
    """Bars of delimited `line`s under one header; without a volume column every volume is 1. Broken numbers and dates go."""
    sep, decimal, thousands = layout(header)
    if re.match(r"\s*<(!|html|head|body)", header, re.IGNORECASE):
        raise ValueError("a page, not a table")
    at = resolve_columns([h.strip() for h in header.split(sep)], column_map)
    part = F.split("line", f"[{sep}]")
    get = lambda k: F.replace(F.get(part, F.lit(at[k])), F.lit('"'), F.lit(""))
    cols = {c: number(get(c), decimal, thousands) if c in at else F.lit(1.0) for c in OHLCV}
    rows = lines.select((symbol if symbol is not None else F.lit("")).alias("symbol"), date(get("date"), sep == ";").alias("ts"), *[v.alias(k) for k, v in cols.items()])
    return validate(rows.filter("ts is not null"))


def read_csv(spark: SparkSession, path: str, symbol: str | None = None, column_map: dict[str, str] | None = None) -> DataFrame:
    """Bars of one file or of a folder of files with the same header; the file's name is the symbol."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    header = lines.filter("trim(line) <> ''").first()
    if header is None:
        raise ValueError(f"{path}: empty")
    name = F.lit(symbol) if symbol else F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.us)?\.[a-z]+$", 1))
    return parse_lines(lines.filter(F.col("line") != header["line"]).filter("trim(line) <> ''"), header["line"], name, column_map)


# --- vendor payloads --------------------------------------------------------

AGGREGATES = "struct<ticker:string,status:string,error:string,results:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>>"
DAILY = "array<struct<symbol:string,date:string,open:double,high:double,low:double,close:double,volume:double>>"
CHART = "struct<symbol:string,timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
KLINES = "array<array<string>>"


def aggregates_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bars of millisecond aggregates; a vendor's error raises."""
    p = payloads.select(F.from_json(column, AGGREGATES).alias("p"))
    p = p.withColumn("p", F.when(F.col("p.error").isNotNull(), F.raise_error(F.concat(F.lit("vendor error: "), F.col("p.error")))).otherwise(F.col("p")))
    r = p.select(F.col("p.ticker").alias("symbol"), F.explode("p.results").alias("r"))
    return validate(r.select("symbol", F.timestamp_millis(F.col("r.t")).alias("ts"), F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.col("r.v").alias("volume")))


def daily_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bars of an array of daily objects, in any order."""
    r = payloads.select(F.explode(F.from_json(column, DAILY)).alias("r"))
    return validate(r.select("r.symbol", F.to_timestamp("r.date").alias("ts"), *[f"r.{c}" for c in OHLCV]))


#: Answers of a vendor that are no data: a plan gate, other failures, and messages in place of bars.
GATED = (402, 403)
ANSWER = "map<string,string>"
TICKERS = "struct<results:array<struct<ticker:string,name:string,active:boolean,delisted_utc:string>>,next_url:string>"


def answers(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads (symbol, code, payload) with outcome: bars, empty, plan_gate, error, and message. Nothing is raised: a bad name ends no run."""
    body = F.trim(F.coalesce(F.col(column), F.lit("")))
    said = F.from_json(F.when(body.startswith("{"), body), ANSWER)
    message = F.coalesce(said["Error Message"], said["error"], said["message"])
    outcome = (
        F.when(F.col("code").isin(*GATED), "plan_gate")
        .when(F.col("code") >= 400, "error")
        .when(body.startswith("{"), "error")
        .when(body.isin("", "[]", "null"), "empty")
        .otherwise("bars")
    )
    text = F.when(outcome == "plan_gate", F.concat("symbol", F.lit(": a higher plan is needed ("), "code", F.lit(")"))).when(outcome == "error", F.concat("symbol", F.lit(": "), F.coalesce(message, F.concat(F.lit("request failed with "), F.col("code").cast("string"))))).when(outcome == "empty", F.concat("symbol", F.lit(": no bars")))
    return payloads.withColumns({"outcome": outcome, "message": text})


def delisted_tickers(pages: DataFrame, column: str = "payload") -> DataFrame:
    """ticker, delisted_utc of reference pages (active = false), all pages that were fetched; a ticker on two pages counts once."""
    r = pages.select(F.explode(F.from_json(column, TICKERS)["results"]).alias("r")).select("r.*")
    return r.filter("not coalesce(active, false)").groupBy("ticker").agg(F.max("delisted_utc").alias("delisted_utc"))


def next_page(url: str | None, key: str) -> str | None:
    """The cursor of a page with the key that it leaves out."""
    if not url or "apiKey=" in url:
        return url or None
    return f"{url}{'&' if '?' in url else '?'}apiKey={key}"


def chart_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bars of parallel arrays with second timestamps."""
    p = payloads.select(F.from_json(column, CHART).alias("p"))
    z = p.select(F.col("p.symbol").alias("symbol"), F.explode(F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in ("timestamp", *OHLCV)])).alias("z"))
    return validate(z.select("symbol", F.timestamp_seconds("z.timestamp").alias("ts"), *[f"z.{c}" for c in OHLCV]))


def kline_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bars of [open time, open, high, low, close, volume, ...] rows, beside a symbol column."""
    k = payloads.select("symbol", F.explode(F.from_json(column, KLINES)).alias("k"))
    return validate(k.select("symbol", F.timestamp_millis(F.get("k", F.lit(0)).cast("bigint")).alias("ts"), *[F.get("k", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(OHLCV)]))


# --- the lake ---------------------------------------------------------------


def write_lake(bars: DataFrame, root: str, caps: DataFrame | None = None, end=None) -> None:
    """root/symbol=.../year=...: one shuffle puts a symbol's year in one file. caps (symbol, cap) ends a symbol's history early."""
    out = bars
    if caps is not None:
        out = out.join(caps.select("symbol", "cap"), "symbol", "left").filter("cap is null or ts <= cap").drop("cap")
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end))
    out.withColumn("year", F.year("ts")).repartition("symbol", "year").sortWithinPartitions("ts").write.mode("overwrite").partitionBy("symbol", "year").parquet(root)


def read_lake(spark: SparkSession, root: str, start=None, end=None, symbols: list[str] | None = None) -> DataFrame:
    """Bars of the lake; symbols and years prune folders, dates are pushed to the files. Later duplicates win."""
    b = spark.read.option("basePath", root).parquet(root)
    b = b.withColumn("symbol", F.col("symbol").cast("string"))
    if symbols:
        b = b.filter(F.col("symbol").isin(symbols))
    if start is not None:
        b = b.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("year") >= F.year(F.lit(start).cast("timestamp"))))
    if end is not None:
        b = b.filter((F.col("ts") <= F.lit(end).cast("timestamp")) & (F.col("year") <= F.year(F.lit(end).cast("timestamp"))))
    return validate(b.select("symbol", "ts", *OHLCV))


def delisted(bars: DataFrame, gap_days: int = 180, known: DataFrame | None = None) -> DataFrame:
    """symbol, last_ts, delisted: the last bar lies more than gap_days before the lake's last one, or the symbol is known to be gone."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    out = last.crossJoin(last.agg(F.max("last_ts").alias("lake_last")))  # one row
    gone = F.datediff("lake_last", "last_ts") > gap_days
    if known is not None:
        out = out.join(F.broadcast(known.select("symbol", F.lit(True).alias("_k")).distinct()), "symbol", "left")
        gone = gone | F.coalesce("_k", F.lit(False))
    return out.select("symbol", "last_ts", gone.alias("delisted"))


def first_source(sources: list[tuple[str, DataFrame]], require: set[str] | None = None, capabilities: dict[str, set[str]] | None = None) -> DataFrame:
    """Bars of the first source in order that has a symbol and the capabilities asked for, with a column source."""
    usable = [(n, d) for n, d in sources if not require or require <= (capabilities or {}).get(n, set())]
    if not usable:
        raise ValueError(f"no source with {require}")
    every = None
    for i, (n, d) in enumerate(usable):
        d = d.select("symbol", "ts", *OHLCV, F.lit(n).alias("source"), F.lit(i).alias("priority"))
        every = d if every is None else every.unionByName(d)
    best = F.min("priority").over(W.partitionBy("symbol"))
    return every.withColumn("_b", best).filter("priority = _b").drop("_b", "priority")


#: The default chain: source, the setting that must be there, what it can serve, and a setting that adds to it.
CHAIN = (
    ("polygon", "POLYGON_API_KEY", {"intraday", "delisted"}, None),
    ("fmp", "FMP_API_KEY", set(), ("VPTS_FMP_DELISTED", "delisted")),
    ("yahoo", None, {"intraday"}, None),
    ("synthetic", None, set(), None),
)


def default_chain(settings: dict[str, str], require: set[str] | None = None) -> list[str]:
    """Names of the sources to ask, in order: those whose key is set, and that can serve what is required."""
    out = []
    for name, key, serves, extra in CHAIN:
        if key and not settings.get(key):
            continue
        able = serves | ({extra[1]} if extra and settings.get(extra[0]) else set())
        if not require or require <= able:
            out.append(name)
    return out


def fresh(cache: DataFrame, requests: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """requests with key (a digest of all their columns) and hit: whether the cache (key, fetched_at) has one no older than the limit."""
    asked = requests.withColumn("key", F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(requests.columns)])))
    young = cache.filter(F.col("fetched_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))).select("key").distinct()
    return asked.join(young.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
