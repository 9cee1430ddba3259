"""Mail and feed jobs (J1-J9) and the HTTP-shape helpers they use
(B29-B31).

Feed digests pick a handful of entries (top-3 reports) with ordered
``limit`` before anything is gathered, so the assembled digest is bounded
by the report size, not by the feed size.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import as_col

LIST_SCHEMA = "struct<messages:array<struct<id:string,threadId:string>>,resultSizeEstimate:int>"


# ---------------------------------------------------------------- J1 / J4 / B29
def split_messages(responses: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per listed message."""
    b = F.from_json(F.col(body_col), LIST_SCHEMA)
    return responses.select("*", F.explode(b["messages"]).alias("m")).select(
        *responses.columns, F.col("m.id").alias("message_id"), F.col("m.threadId").alias("thread_id"))


def no_message_markers(responses: DataFrame, key_col: str, body_col: str = "body") -> DataFrame:
    """A ``NO_MESSAGES`` marker for every list response without messages."""
    b = F.from_json(F.col(body_col), LIST_SCHEMA)
    n = F.coalesce(F.size(b["messages"]), F.lit(0))
    return responses.where((n <= 0)).select(F.col(key_col), F.lit("NO_MESSAGES").alias("status"),
                                            F.lit("No messages in INBOX or all filtered").alias("note"))


def normalize_http(df: DataFrame, resp_col: str = "response") -> DataFrame:
    """Status from ``statusCode``, numeric ``status`` or the Gmail
    shape (messages / resultSizeEstimate -> 200); error from ``error`` or
    ``message``; ok = 2xx."""
    r = F.col(resp_col)
    g = lambda p: F.get_json_object(r, p)
    sc = g("$.statusCode").try_cast("int")
    st_raw = g("$.status")
    st = F.when(st_raw.rlike(r"^-?\d+$"), st_raw.try_cast("int"))
    gmail = g("$.messages").isNotNull() | g("$.resultSizeEstimate").isNotNull()
    status = (F.when(sc.isNotNull(), sc).when(st.isNotNull(), st).when(gmail, F.lit(200))
              .otherwise(F.coalesce(sc, st, F.lit(0))))
    err = F.coalesce(F.nullif(g("$.error"), F.lit("")), F.nullif(g("$.message"), F.lit("")))
    ok = (status >= 200) & (status < 300)
    return df.select("*", status.alias("http_status"), err.alias("http_error"), ok.alias("ok"))


def normalize_metadata(df: DataFrame, resp_col: str = "response") -> DataFrame:
    """B29 for a metadata reply: status from ``statusCode`` or a numeric
    ``status``, else 200 for a bare object; the body is the given text parsed
    as JSON, or its first 1000 characters as ``rawText`` with an error; an API
    error in the body gives message and code; ok = 2xx and no error."""
    r = F.col(resp_col)
    whole = F.try_parse_json(r)
    sc = F.try_variant_get(whole, "$.statusCode", "int")
    st = F.when(F.schema_of_variant(F.try_variant_get(whole, "$.status", "variant")) == "BIGINT", F.try_variant_get(whole, "$.status", "int"))
    wrapped = sc.isNotNull() | st.isNotNull()
    inner = F.try_variant_get(whole, "$.body", "variant")
    is_text = F.coalesce(F.schema_of_variant(inner) == "STRING", F.lit(False))
    text = F.when(is_text, F.try_variant_get(whole, "$.body", "string"))
    parsed = F.try_parse_json(text)
    body = (F.when(~wrapped, F.to_json(whole))
            .when(is_text, F.coalesce(F.to_json(parsed), F.to_json(F.struct(F.substring(text, 1, 1000).alias("rawText")))))
            .when(inner.isNotNull(), F.to_json(inner)).when(sc.isNull(), F.to_json(whole)).otherwise(F.lit("{}")))
    out = df.select("*", F.coalesce(sc, st, F.lit(200)).alias("_status"), body.alias("body"),
                    F.when(wrapped & is_text & parsed.isNull(), F.lit("body is not JSON")).alias("_bad"),
                    F.coalesce(F.nullif(F.get_json_object(r, "$.error"), F.lit("")), F.nullif(F.get_json_object(r, "$.message"), F.lit(""))).alias("_said"))
    api = F.get_json_object("body", "$.error")
    has_api = F.coalesce(api != "", F.lit(False)) & (F.col("body") != "{}")
    error = F.when(has_api, F.coalesce(F.get_json_object("body", "$.error.message"), api)).otherwise(F.coalesce("_said", "_bad"))
    status = F.when(has_api, F.coalesce(F.get_json_object("body", "$.error.code").try_cast("int"), F.col("_status"))).otherwise(F.col("_status"))
    return (out.withColumn("http_status", status).withColumn("http_error", error)
            .withColumn("ok", (F.col("http_status") >= 200) & (F.col("http_status") < 300) & F.col("http_error").isNull())
            .drop("_status", "_bad", "_said"))


def tolerant_parse(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``METADATA_EMPTY`` for blank text, ``METADATA_PARSE_ERROR``
    (with a 200-char sample) when the text is not JSON, else ``OK``."""
    r = F.col(raw_col)
    v = F.try_parse_json(r)
    blank = r.isNull() | (F.trim(r) == "")
    status = F.when(blank, "METADATA_EMPTY").when(v.isNull(), "METADATA_PARSE_ERROR").otherwise("OK")
    return df.select("*", status.alias("parse_status"),
                     F.when(~blank & v.isNull(), F.substring(r, 1, 200)).alias("sample"))


def first_message(messages: DataFrame, group_col: str, order_col: str, id_col: str,
                  snippet_col: str) -> DataFrame:
    """The first message per group (smallest ``order_col``, ties by
    ``id_col``) with a 100-char snippet.  ``min_by`` aggregates map-side,
    so a hot group costs one row per task in the shuffle."""
    cols = [c for c in messages.columns if c != group_col]
    first = messages.groupBy(group_col).agg(
        F.min_by(F.struct(*cols), F.struct(order_col, id_col)).alias("_m"))
    return (first.select(group_col, "_m.*")
            .withColumn("snippet", F.substring(F.col(snippet_col), 1, 100))
            .withColumn("status", F.lit("READONLY_OK")))


# ---------------------------------------------------------------- J2 / J9
def header(headers_col: str, name: str) -> Column:
    """Header value by case-insensitive name, ``Unknown`` if absent."""
    hit = F.filter(F.col(headers_col), lambda h: F.lower(F.coalesce(h["name"], F.lit(""))) == name.lower())
    return F.when(F.size(hit) > 0, F.try_element_at(hit, F.lit(1))["value"]).otherwise(F.lit("Unknown"))


def email_prompt(df: DataFrame) -> DataFrame:
    """Analysis prompt text and the metadata struct for the router."""
    frm = F.coalesce(F.nullif(F.col("from"), F.lit("")), F.lit("Unknown"))
    subj = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("No Subject"))
    date = F.coalesce(F.nullif(F.col("date"), F.lit("")), F.lit("Unknown"))
    mid = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.lit("unknown"))
    tid = F.coalesce(F.nullif(F.col("thread_id"), F.lit("")), mid)
    prompt = F.concat(
        F.lit("[Gmail Email Analysis]\n\nFrom: "), frm, F.lit("\nSubject: "), subj, F.lit("\nDate: "), date,
        F.lit("\nMessage ID: "), mid, F.lit(EMAIL_PROMPT_TAIL))
    meta = F.struct(F.lit("gmail").alias("source"), mid.alias("message_id"), tid.alias("thread_id"),
                    frm.alias("from"), subj.alias("subject"), date.alias("date"))
    return df.select("*", F.lit("gmail").alias("tenant_id"), F.lit("email-analysis").alias("scope"),
                     prompt.alias("prompt"), meta.alias("meta"))


# Fixed value: instruction block of the mail analysis prompt.
EMAIL_PROMPT_TAIL = (
    "\n\nPlease analyze this email and provide:\n1. SUMMARY: A concise summary in 6 lines or less\n"
    "2. PRIORITY: Rate as High/Medium/Low with brief reason\n3. NEXT ACTIONS: Bullet points of suggested actions\n"
    "4. DRAFT REPLY: A polite business draft reply (in Japanese by default; if the email appears to be in "
    "English, provide English draft)]")


# ---------------------------------------------------------------- J5-J8
def normalize_text(c, limit: int = 160, ellipsis: bool = False) -> Column:
    """Collapse whitespace runs, trim, cut at ``limit`` (``...`` when
    cut, in the executor variant)."""
    t = F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"\s+", " "))
    cut = F.substring(t, 1, limit)
    return F.when(F.lit(ellipsis) & (F.length(t) > limit), F.concat(cut, F.lit("..."))).otherwise(cut)


def js_number_text(c) -> Column:
    """A number rendered as JavaScript's ``String(n)`` (no ``.0``)."""
    x = as_col(c)
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def newest_kev(kev: DataFrame, order_col: str, n: int = 3) -> DataFrame:
    """The last ``n`` entries of the list, newest first (top-n report)."""
    return kev.orderBy(F.col(order_col).desc()).limit(n)


def first_cves(nvd: DataFrame, order_col: str, n: int = 3) -> DataFrame:
    """First ``n`` entries; CVSS = v3.1 ?? v3.0 ?? v2 ?? '-'; English
    description."""
    score = F.coalesce(js_number_text("cvss_v31"), js_number_text("cvss_v30"), js_number_text("cvss_v2"),
                       F.lit("-"))
    desc = F.coalesce(F.try_element_at(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(1))["value"], F.lit(""))
    return (nvd.orderBy(F.col(order_col).asc()).limit(n)
            .select("*", score.alias("cvss"), desc.alias("description_en")))


def factual_digest(kev: DataFrame, nvd: DataFrame, as_of: _dt.datetime, kev_order: str = "pos",
                   nvd_order: str = "pos") -> DataFrame:
    """The factual digest text (ordered lines joined by newlines) with
    list totals and the date label.  Only the top-3 rows of each list and
    a few header lines are gathered."""
    label = as_of.strftime("%Y-%m-%d")
    # row numbers over the three selected rows only (after the limit)
    top_k = newest_kev(kev, kev_order).withColumn("_i", F.row_number().over(Window.orderBy(F.col(kev_order).desc())))
    top_n = first_cves(nvd, nvd_order).withColumn("_i", F.row_number().over(Window.orderBy(F.col(nvd_order).asc())))
    note = normalize_text("shortDescription")
    kev_lines = top_k.select(F.lit(1).alias("_s"), "_i", F.array(
        F.concat(F.lit("- "), F.coalesce(F.nullif("cveID", F.lit("")), F.lit("N/A")), F.lit(" | "),
                 F.coalesce(F.nullif("vendorProject", F.lit("")), F.lit("Unknown")), F.lit(" "),
                 F.coalesce(F.col("product"), F.lit("")), F.lit(" | due="),
                 F.coalesce(F.nullif("dueDate", F.lit("")), F.lit("-"))),
        F.when(F.coalesce(F.col("shortDescription"), F.lit("")) != "", F.concat(F.lit("  note: "), note))
    ).alias("_l"))
    pub = F.coalesce(F.substring("published", 1, 10), F.lit("-"))
    nvd_lines = top_n.select(F.lit(2).alias("_s"), "_i", F.array(
        F.concat(F.lit("- "), F.coalesce(F.nullif("id", F.lit("")), F.lit("N/A")), F.lit(" | CVSS="),
                 F.col("cvss"), F.lit(" | published="), pub),
        F.when(F.col("description_en") != "", F.concat(F.lit("  summary: "), normalize_text("description_en")))
    ).alias("_l"))
    lines = kev_lines.unionByName(nvd_lines).select("_s", "_i", F.posexplode("_l").alias("_j", "line")) \
                     .where(F.col("line").isNotNull())
    body = lines.agg(F.sort_array(F.collect_list(F.struct("_s", "_i", "_j", "line"))).alias("_a"))
    n_kev = kev.agg(F.count(F.lit(1))).scalar()
    n_nvd = nvd.agg(F.count(F.lit(1))).scalar()

    def section(s):
        part = F.transform(F.filter("_a", lambda x: x["_s"] == s), lambda x: x["line"])
        return F.when(F.size(part) > 0, F.array_join(part, "\n")).otherwise(F.lit("- none"))

    text = F.concat_ws("\n", F.lit(f"Date: {label}"), F.concat(F.lit("CISA_KEV_Total: "), n_kev.cast("string")),
                       F.concat(F.lit("NVD_24h_Total: "), n_nvd.cast("string")), F.lit(""),
                       F.lit("### CISA KEV (Top 3)"), section(1), F.lit(""),
                       F.lit("### NVD New CVEs (Top 3)"), section(2))
    return body.select(F.lit(label).alias("date_label"), n_kev.alias("kev_total"), n_nvd.alias("nvd_total"),
                       text.alias("factual_digest"))
