"""Column expressions for fetch lineage: request keys, bronze paths, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def request_key(url: Column | str, base: str) -> tuple[Column, Column]:
    """URL → (endpoint, request_key).

    The base prefix and trailing slashes are stripped only when the URL starts
    with ``base``. Known shapes: ``bootstrap-static``, ``fixtures``,
    ``element-summary/{id}`` → ``element-summary:{id}``,
    ``entry/{team}/event/{gw}/picks`` → ``entry:{team}:{gw}``,
    ``entry/{team}/history`` → ``entry:{team}:history``; anything else: endpoint
    = first path segment, key = path with ``/`` → ``:``.
    """
    u = _col(url)
    rest = F.when(
        u.startswith(base), F.regexp_replace(F.substring(u, F.lit(len(base) + 1), F.length(u)), "/+$", "")
    ).otherwise(u)
    summary = F.regexp_extract(rest, r"^element-summary/([0-9]+)", 1)
    picks_team = F.regexp_extract(rest, r"^entry/([0-9]+)/event/([0-9]+)/picks", 1)
    picks_gw = F.regexp_extract(rest, r"^entry/([0-9]+)/event/([0-9]+)/picks", 2)
    hist_team = F.regexp_extract(rest, r"^entry/([0-9]+)/history", 1)
    fallback_ep = F.when(F.instr(rest, "/") > 0, F.split_part(rest, F.lit("/"), F.lit(1))).otherwise(rest)
    fallback_key = F.replace(rest, F.lit("/"), F.lit(":"))
    known = rest.isin("bootstrap-static", "fixtures")
    endpoint = (
        F.when(known, rest)
        .when(summary != "", F.lit("element-summary"))
        .when((picks_team != "") | (hist_team != ""), F.lit("entry"))
        .otherwise(fallback_ep)
    )
    key = (
        F.when(known, rest)
        .when(summary != "", F.concat(F.lit("element-summary:"), summary))
        .when(picks_team != "", F.concat_ws(":", F.lit("entry"), picks_team, picks_gw))
        .when(hist_team != "", F.concat_ws(":", F.lit("entry"), hist_team, F.lit("history")))
        .otherwise(fallback_key)
    )
    return endpoint, key


def key_id(request_key: Column | str, prefix: str = "element-summary:") -> Column:
    """``element-summary:{id}`` → id; other prefixes or a bad suffix → NULL."""
    k = _col(request_key)
    return F.when(k.startswith(prefix), F.split_part(k, F.lit(":"), F.lit(2)).try_cast("bigint"))


def bronze_path(root: str, endpoint: Column | str, fetched_at: Column | str, player_id: Column | str) -> Column:
    """Bronze file path: ``{root}/element-summary/{player}/{YYYY-MM-DD}/{HHMMSS}.json``
    for per-player summaries, else ``{root}/{endpoint with / → -}/{YYYY-MM-DDTHH-MM-SSZ}.json``."""
    ep, ts, pid = _col(endpoint), _col(fetched_at), _col(player_id)
    per_player = F.concat_ws(
        "/", F.lit(root), ep, pid.cast("string"), F.date_format(ts, "yyyy-MM-dd"),
        F.concat(F.date_format(ts, "HHmmss"), F.lit(".json")),
    )
    other = F.concat_ws(
        "/", F.lit(root), F.replace(ep, F.lit("/"), F.lit("-")),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'"), F.lit(".json")),
    )
    return F.when((ep == "element-summary") & pid.isNotNull(), per_player).otherwise(other)


def variant_digest(document: Column | str) -> Column:
    """SHA-256 of a VARIANT's canonical JSON (object keys sorted at every level, no whitespace); NULL → NULL."""
    v = _col(document)
    return F.when(v.isNotNull(), F.sha2(F.to_json(v), 256))


def payload_digest(payload: Column | str) -> Column:
    """The digest of a document's text: reordered keys give the same one; malformed → NULL."""
    return variant_digest(F.try_parse_json(_col(payload)))
