"""Secret scans: strong patterns, and weak ones that only count where their complements are.

A credential has parts: an access identifier, a secret, and an endpoint. The base kinds
``assign``, ``access`` and ``hex`` are reported wherever they stand. The weak kinds are
reported only in company:

- ``login`` (a value named as user, client or key id) near a base secret, or near an
  ``opaque`` and an ``endpoint``;
- ``opaque`` (20 or more characters of all of A-Z, a-z, 0-9 that no other span touches) near
  an ``access``, or near a ``login`` and an ``endpoint``;
- ``endpoint`` (a URL of a service or database, or a named host) near an identifier and a
  secret of any strength.

Near means: in one scope (blank lines part scopes), without overlap, and with at most
``reach`` code points between them that no span covers, however long they and the spans
between them are. That interval join is two running extremes over the ends and starts of all
spans in order of place: the last end before a span's start and the first start after its
end, for every kind; no pairs are made. All of it is DataFrame
functions; positions are sums of the lengths that ``split`` and ``regexp_extract_all`` leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultweave.llm.common import text_key
from faultweave.session import materialise

#: The order of the kinds, their patterns, and what a match must hold to count.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_URL = r"""(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"'<>]+"""
KINDS: dict[str, str] = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "login": r"""(?i)(?:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""",
    "opaque": r"[A-Za-z0-9+/_=-]{20,}",
    "endpoint": rf"""(?i)(?:{_URL}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?(?:{_URL}|[A-Za-z0-9._-]+))""",
    "scope": r"\n[\x20\x09\x0B-\x0D]*\n\s*",
}
BASE = ("assign", "access", "hex")
REACH = 300


def _accepted(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, _ASSIGN, 2)) >= 6
    if kind == "opaque":
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, place, gap before, match) of a pattern's matches in order."""
    pattern = F.lit(KINDS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, KINDS[kind], -1)
    parts = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        found,
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"), F.length(match).alias("length"), _accepted(kind, match).alias("ok")
        ),
    )
    return F.when(text.rlike(KINDS[kind]), parts)


def credential_spans(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(``text_key``, ``kind``, ``start``, ``end``) of all spans of each different text.

    Base kinds: leftmost matches without overlap per kind. Weak kinds: as the module says.
    Offsets are code points, the end exclusive. Texts without spans have no rows; null texts
    count as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    wide = docs.select(text_key(text).alias("text_key"), *[_matches(text, k).alias(k) for k in KINDS])
    any_part = F.greatest(*[F.coalesce(F.size(k), F.lit(0)) for k in KINDS if k != "scope"]) > 0
    # copies give equal rows, so one of them is enough
    first = [F.first(k, ignorenulls=True).alias(k) for k in KINDS]
    wide = wide.where(any_part).groupBy("text_key").agg(*first)
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(k).alias("parts")) for i, k in enumerate(KINDS)])
    kinds = wide.select("text_key", F.explode(listed).alias("k"))
    parts = kinds.select("text_key", F.col("k.rank").alias("rank"), F.posexplode("k.parts").alias("place", "p"))
    in_kind = Window.partitionBy("text_key", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("p.gap") + F.col("p.length")).over(in_kind)
    placed = parts.select(
        "text_key", "rank", end.alias("end"), F.col("p.length").alias("length"), F.col("p.ok").alias("ok")
    )
    placed = placed.where("ok").select(
        "text_key", "rank", (F.col("end") - F.col("length")).cast("int").alias("start"), F.col("end").cast("int").alias("end")
    )

    number = {k: i for i, k in enumerate(KINDS)}
    is_kind = lambda *kinds: F.col("rank").isin([number[k] for k in kinds])
    # of spans that begin together the opaque one comes last, so that it sees the others
    along = Window.partitionBy("text_key").orderBy("start", is_kind("opaque"), "rank")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    clear = ~is_kind("opaque", "scope")
    scoped = placed.select(
        "*",
        F.sum(is_kind("scope").cast("int")).over(so_far).alias("scope"),
        F.max(F.when(clear, F.col("end"))).over(so_far).alias("covered"),
        F.min(F.when(clear, F.col("start"))).over(later).alias("next"),
    )
    touched = (F.coalesce("covered", F.lit(0)) > F.col("start")) | (F.col("next") < F.col("end"))
    scoped = scoped.where(~is_kind("scope") & ~(is_kind("opaque") & F.coalesce(touched, F.lit(False))))

    places = F.array(*[F.struct(F.col(c).alias("at"), F.lit(c == "start").alias("starts")) for c in ("start", "end")])
    events = scoped.select("text_key", "scope", "rank", "start", "end", F.explode(places).alias("e"))
    # an end comes before a start at the same place
    by_place = Window.partitionBy("text_key", "scope").orderBy("e.at", "e.starts")
    # how many code points before each end or start no span covers
    is_open = F.sum(F.when(F.col("e.starts"), 1).otherwise(-1)).over(by_place.rowsBetween(Window.unboundedPreceding, -1)) > 0
    step = F.when(~is_open, F.col("e.at") - F.lag("e.at").over(by_place))
    events = events.withColumn("step", F.coalesce(step, F.lit(0)))
    events = events.withColumn("free", F.sum("step").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    before = by_place.rangeBetween(Window.unboundedPreceding, 0)
    after = by_place.rangeBetween(0, Window.unboundedFollowing)
    groups = {"secret": ("assign", "hex"), "access": ("access",), "login": ("login",), "opaque": ("opaque",), "endpoint": ("endpoint",)}
    sides = []
    for name, kinds in groups.items():
        last_end = F.max(F.when(is_kind(*kinds) & ~F.col("e.starts"), F.col("free"))).over(before)
        first_start = F.min(F.when(is_kind(*kinds) & F.col("e.starts"), F.col("free"))).over(after)
        gap = F.when(F.col("e.starts"), F.col("free") - last_end).otherwise(first_start - F.col("free"))
        sides.append((gap <= reach).alias(name))
    judged = events.select("text_key", "rank", "start", "end", *sides)
    judged = judged.groupBy("text_key", "rank", "start", "end").agg(
        *[F.coalesce(F.bool_or(name), F.lit(False)).alias(name) for name in groups]
    )
    kept = (
        (F.col("rank") <= number["hex"])
        | ((F.col("rank") == number["login"]) & (F.col("secret") | (F.col("opaque") & F.col("endpoint"))))
        | ((F.col("rank") == number["opaque"]) & (F.col("access") | (F.col("login") & F.col("endpoint"))))
        | (
            (F.col("rank") == number["endpoint"])
            & (F.col("access") | F.col("login"))
            & (F.col("secret") | F.col("opaque"))
        )
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    return judged.where(kept).select("text_key", F.get(names, F.col("rank")).alias("kind"), "rank", "start", "end")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_weak``) of every row.

    Spans are ``kind:start:end`` by start, then kind, joined by commas; the digest covers the
    base kinds alone. Rows without spans have zeros, the digest of nothing and an empty string.
    """
    spans = credential_spans(docs, text_col, reach)
    one = F.struct(F.col("start"), F.col("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    count = lambda k: F.count(F.when(F.col("kind") == k, F.lit(1)))
    per_text = spans.groupBy("text_key").agg(
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.count(F.when(~F.col("kind").isin(*BASE), F.lit(1))).alias("n_weak"),
        F.sort_array(F.collect_list(one)).alias("all"),
    )
    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    per_text = per_text.select(
        "text_key",
        *[f"n_{k}" for k in BASE],
        "n_weak",
        F.sha2(F.array_join(base["said"], ","), 256).alias("base_sha256"),
        F.array_join(F.col("all")["said"], ",").alias("spans"),
    )
    per_text = materialise(per_text, "spans")
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    both = rows.join(per_text, "text_key", "left")
    zero = F.lit(0).cast("long")
    return both.select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_weak", zero).alias("n_weak"),
    )
