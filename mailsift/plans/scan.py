"""Source queries: the readers' parsing rules applied to the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import lines
from mailsift.plans import views
from mailsift.plans.book import Book
from mailsift.plans.views import WS, oracle
from mailsift.sources import csv, eml, textmail
from mailsift.sources.tables import table

book = Book()
query = book.query


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def doc_lines(spark, sf):
    d = views.documents(spark, sf)
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = ("ln", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::int AS line_no FROM documents")
FIELDS5 = ["c1", "c2", "c3", "c4", "c5"]


@query(
    "csv_lenient",
    oracle(
        "SELECT doc_id, line_no, " + ", ".join(f"nullif(string_split(line, ',')[{i}], '') AS c{i}" for i in range(1, 6))
        + " FROM ln WHERE len(string_split(line, ',')) <= 5",
        extra=[LINES],
    ),
)
def csv_lenient(spark, sf):
    return csv.parse_lenient(doc_lines(spark, sf), "line", FIELDS5, ["doc_id", "line_no"])


@query(
    "csv_positional",
    """SELECT page_id, 'bot@' || page_id AS sender, url AS subject, replace(regexp_replace(html, '[\\n\\r]', ' ', 'g'), ',', ';') AS body,
      CASE WHEN page_id % 3 = 1 THEN 'phishing' END AS only_phishing, CASE page_id % 3 WHEN 1 THEN 'phishing' WHEN 0 THEN 'legitimate' END AS label FROM pages""".replace("\\\\", "\\"),
)
def csv_positional(spark, sf):
    """Pages written as seven-field lines and read back by position."""
    body = F.translate(F.regexp_replace("html", r"[\n\r]", " "), ",", ";")
    line = F.concat_ws(",", F.concat(F.lit("bot@"), "page_id"), F.lit("me"), F.lit("2024"), "url", body, F.lit("u"), (F.col("page_id") % 3).cast("string"))
    rows = csv.parse_lenient(views.pages(spark, sf).select("page_id", line.alias("line")), "line", csv.SEVEN, ["page_id"])
    one = csv.positional(rows.withColumn("digit", F.col("label")), only_phishing=True).withColumnRenamed("label", "only_phishing")
    both = csv.positional(one.withColumnRenamed("digit", "label"))
    return both.select("page_id", F.col("from").alias("sender"), "subject", "body", "only_phishing", "label")


@query(
    "wide_source",
    """SELECT doc_id, lang, n_chars, nullif(text, '') AS text, quality AS "class", text AS body,
      CASE quality WHEN 1 THEN 'phishing' WHEN 0 THEN 'legitimate' END AS label FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL""",
)
def wide_source(spark, sf):
    d = views.documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return csv.wide(d.select("doc_id", "lang", "n_chars", "text", F.col("quality").alias("class")))


def eml_bytes(spark, sf):
    """Documents as MIME messages: plain, html and two-part bodies."""
    m = views.mail(spark, sf)

    def b64(c):
        return F.base64(F.encode(c, "UTF-8"))

    def part(kind, c):
        return F.concat(
            F.lit(f"Content-Type: text/{kind}; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(c), F.lit("\r\n")
        )

    html = F.concat(F.lit("<p>"), "body", F.lit("</p><br>"))
    two = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="XX"\r\n\r\n--XX\r\n'), part("html", html),
        F.lit("--XX\r\n"), part("plain", F.col("body")), F.lit("--XX\r\n"), part("plain", F.col("subject")),
        F.lit("--XX\r\nContent-Disposition: attachment; filename=a.txt\r\n"), part("plain", F.lit("never")), F.lit("--XX--\r\n"),
    )
    kind = F.col("msg_id") % 3
    body = F.when(kind == 0, part("plain", F.col("body"))).when(kind == 1, part("html", html)).otherwise(two)
    raw = F.concat(
        F.lit("From: "), "from", F.lit("\r\nReply-To: "), F.coalesce("reply_to", F.lit("")),
        F.lit("\r\nSubject: =?utf-8?B?"), b64(F.col("source_file")), F.lit("?=\r\nMIME-Version: 1.0\r\n"), body,
    )
    return m.select("msg_id", F.encode(raw, "UTF-8").alias("content"))


def _eml_sql(html, two):
    return oracle(
        f"""SELECT msg_id, "from" AS sender, coalesce(reply_to, '') AS reply_to, source_file AS subject,
          CASE msg_id % 3 WHEN 0 THEN body WHEN 1 THEN {html} ELSE {two} END AS body FROM mail""",
        "mail",
    )


@query("eml_scan", _eml_sql("regexp_replace('<p>' || body || '</p><br>', '<[^>]+>', ' ', 'g')", "body"))
def eml_scan(spark, sf):
    parsed = eml.parse_eml(eml_bytes(spark, sf), "content", {"msg_id": "bigint"}, "first")
    return parsed.withColumnRenamed("from", "sender")


@query("eml_scan_concat", _eml_sql("'<p>' || body || '</p><br>'", "'<p>' || body || '</p><br>' || body || subject"))
def eml_scan_concat(spark, sf):
    parsed = eml.parse_eml(eml_bytes(spark, sf), "content", {"msg_id": "bigint"}, "concat")
    return parsed.withColumnRenamed("from", "sender")


@query(
    "text_mail",
    f"""SELECT doc_id, {strip_sql("split_part(text, chr(10), 1)")} AS subject,
      CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END
        || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'FROM: x@' || source || '.example ' ELSE '' END AS body,
      CASE WHEN doc_id % 2 = 0 THEN 'x@' || source || '.example' ELSE '' END AS sender, '' AS reply_to FROM documents""",
)
def text_mail(spark, sf):
    """Documents as text mail: half with a prefix, a blank line and a late sender."""
    d = views.documents(spark, sf)
    first = F.substring_index("text", "\n", 1)
    rest = F.substring("text", F.length(first) + 2, F.length("text"))
    dressed = F.concat(F.lit("Subject: "), first, F.lit("\n  \n"), rest, F.lit("\nFROM: x@"), "source", F.lit(".example "))
    d = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, dressed).otherwise(F.col("text")).alias("text"))
    return textmail.parse_text_mail(d, "text", ["doc_id"]).withColumnRenamed("from", "sender")


@query("row_pick", "SELECT 'hit' AS kind, doc_id, lang FROM documents WHERE doc_id = (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1 OFFSET 37) UNION ALL SELECT 'miss', doc_id, lang FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def row_pick(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    hit = csv.pick_row(d, "doc_id", 37).select(F.lit("hit").alias("kind"), "doc_id", "lang")
    miss = csv.pick_row(d, "doc_id", 10**12).select(F.lit("miss").alias("kind"), "doc_id", "lang")
    return hit.unionByName(miss)


# --- line assembler ------------------------------------------------------------------

def dump_lines(spark, sf):
    """Documents of one source as one dump with headers, late headers and gaps."""
    m = views.mail(spark, sf)
    kind = F.col("msg_id") % 5
    body = F.when(kind == 1, F.replace(F.col("body"), F.lit("\n"), F.lit("\nDate: 2024\n"))).when(
        kind == 2, F.replace(F.col("body"), F.lit("\n"), F.lit("\n \n"))
    ).otherwise(F.col("body"))
    text = F.when(kind == 0, F.lit("From: ghost\nSubject:\n")).otherwise(
        F.concat(F.lit("Subject: "), "subject", F.lit("\nFrom: "), "from", F.lit("\nTo: me\n"), body, F.lit("\n"))
    )
    name = F.when(F.col("source_file").endswith("2"), F.concat(F.lit("phish-"), "source_file")).otherwise(F.col("source_file"))
    rows = m.select(name.alias("file"), "msg_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    # a block is a bounded run of lines: a thousand documents
    return rows.select(
        "file", F.floor(F.col("msg_id") / 1000).alias("block"), (F.col("msg_id") * 1_000_000 + F.col("pos")).alias("line_no"), "line"
    )


DUMP = (
    "dump",
    f"""SELECT file, msg_id * 1000000 + pos AS ord, {strip_sql('line')} AS line FROM (SELECT file, msg_id, unnest(string_split(txt, chr(10))) AS line, unnest(range(0, len(string_split(txt, chr(10))))) AS pos FROM (
      SELECT CASE WHEN ends_with(source_file, '2') THEN 'phish-' || source_file ELSE source_file END AS file, msg_id, CASE WHEN msg_id % 5 = 0 THEN 'From: ghost' || chr(10) || 'Subject:' || chr(10)
        ELSE 'Subject: ' || subject || chr(10) || 'From: ' || "from" || chr(10) || 'To: me' || chr(10) ||
          CASE msg_id % 5 WHEN 1 THEN replace(body, chr(10), chr(10) || 'Date: 2024' || chr(10)) WHEN 2 THEN replace(body, chr(10), chr(10) || ' ' || chr(10)) ELSE body END || chr(10) END AS txt FROM mail))""",
)


def assemble_sql(boundary, reset=True, with_date=True):
    date = "WHEN starts_with(line, 'Date:') THEN 'date'" if with_date else ""
    flag = "line = ''" if boundary == "blank" else "kind = 'subject'"

    def last(kind, n):
        return f"arg_max({strip_sql(f'substr(line, {n})')}, ord) FILTER (kind = '{kind}')"

    body = (
        "coalesce(string_agg(line, ' ' ORDER BY ord) FILTER (kind = 'body' AND ord > h), '')"
        if reset
        else "coalesce(' ' || string_agg(line, ' ' ORDER BY ord) FILTER (kind = 'body'), '')"
    )
    dates = f", {last('date', 6)} AS date" if with_date else ""
    return oracle(
        f"""SELECT file, rec, coalesce({last('subject', 9)}, '') AS subject, {last('from', 6)} AS sender, {last('receiver', 4)} AS receiver{dates}, {body} AS body,
          CASE WHEN contains(lower(file), 'phish') THEN 'phishing' ELSE 'unknown' END AS label
        FROM (SELECT *, coalesce(max(CASE WHEN kind <> 'body' AND ord < e THEN ord END) OVER (PARTITION BY file, rec), -1) AS h
          FROM (SELECT *, max(CASE WHEN kind = 'body' THEN ord END) OVER (PARTITION BY file, rec) AS e FROM recs))
        GROUP BY file, rec HAVING coalesce({last('subject', 9)}, '') <> '' OR count(*) FILTER (kind = 'body') > 0""",
        "mail",
        extra=[
            DUMP,
            ("kinds", f"""SELECT *, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, 'Subject:') THEN 'subject' WHEN starts_with(line, 'From:') THEN 'from'
               WHEN starts_with(line, 'To:') THEN 'receiver' {date} ELSE 'body' END AS kind FROM dump"""),
            ("segs", f"SELECT * FROM (SELECT *, sum(({flag})::int) OVER (PARTITION BY file ORDER BY ord) AS seg FROM kinds) WHERE kind <> 'blank'"),
            ("seg_full", f"SELECT file, seg, (coalesce({last('subject', 9)}, '') <> '' OR count(*) FILTER (kind = 'body') > 0)::int AS full_seg FROM segs GROUP BY file, seg"),
            ("seg_rec", "SELECT file, seg, (sum(full_seg) OVER (PARTITION BY file ORDER BY seg) - full_seg)::bigint AS rec FROM seg_full"),
            ("recs", "SELECT segs.*, rec FROM segs JOIN seg_rec USING (file, seg)"),
        ],
    )


def _assembled(spark, sf, **options):
    return lines.assemble(dump_lines(spark, sf), **options).withColumnRenamed("from", "sender")


@query("assemble_blank", assemble_sql("blank"))
def assemble_blank(spark, sf):
    return _assembled(spark, sf)


@query("assemble_subject", assemble_sql("subject"))
def assemble_subject(spark, sf):
    return _assembled(spark, sf, boundary="subject")


@query("assemble_generic", assemble_sql("blank", reset=False, with_date=False))
def assemble_generic(spark, sf):
    return _assembled(spark, sf, late_header="append", with_date=False)


HEAD20 = "array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10))"
COMMAS = f"(length({HEAD20}) - length(replace({HEAD20}, ',', '')))"


@query(
    "split_two",
    f"""SELECT doc_id, label, line_no, {strip_sql("string_split(line, ',')[1]")} AS subject, {strip_sql("string_split(line, ',')[2]")} AS body FROM (
      SELECT doc_id, CASE WHEN contains(lower(source), 'phish') THEN 'phishing' ELSE 'unknown' END AS label, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::int AS line_no FROM documents WHERE {COMMAS} > 20)
      WHERE {strip_sql('line')} <> '' AND len(string_split(line, ',')) >= 2""",
)
def split_two(spark, sf):
    return csv.split_two(views.documents(spark, sf), "text", ["doc_id"], "source")


def _votes():
    def n(d):
        return f"length({HEAD20}) - length(replace({HEAD20}, {d}, ''))"

    return [(d, n(d)) for d in ("','", "';'", "chr(9)", "'|'")]


@query(
    "delimiter_vote",
    "SELECT doc_id, CASE " + " ".join(f"WHEN {n} = greatest({', '.join(x for _, x in _votes())}) THEN {d}" for d, n in _votes()) + " END AS delimiter FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', ';') WHEN doc_id % 3 = 1 THEN replace(text, ' ', '|') ELSE text END AS text FROM documents)",
)
def delimiter_vote(spark, sf):
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.translate("text", " ", ";")).when(kind == 1, F.translate("text", " ", "|")).otherwise(F.col("text"))
    return views.documents(spark, sf).select("doc_id", csv.delimiter_vote(text).alias("delimiter"))


@query(
    "ragged_align",
    oracle(
        "SELECT doc_id, line_no, " + ", ".join(f"coalesce({strip_sql(f'p[{i}]')}, '') AS f{i}" for i in range(1, 5)) + " FROM (SELECT doc_id, line_no, string_split(line, ',') AS p FROM ln)",
        extra=[LINES],
    ),
)
def ragged_align(spark, sf):
    fields = doc_lines(spark, sf).select("doc_id", "line_no", csv.align_fields(F.split("line", ","), 4).alias("a"))
    return fields.select("doc_id", "line_no", *[F.get("a", F.lit(i)).alias(f"f{i + 1}") for i in range(4)])


@query("header_fix", "SELECT doc_id AS column_0, lang AS column_1, source AS \"Body Text\" FROM documents")
def header_fix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.toDF(*csv.header_names(["", "12", " Body Text "]))


@query("role_infer", "SELECT page_id, url AS \"Mail Title\", html AS \"message_text\", page_id AS spam_class, url AS subject, html AS body, page_id AS label FROM pages")
def role_infer(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("Mail Title"), F.col("html").alias("message_text"), F.col("page_id").alias("spam_class")
    )
    return csv.with_roles(p)


#: Documents as small files: their separator and header mode go by id.
_SEP = "CASE doc_id % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE '~' END"
_FILES = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id' || {_SEP} || 'lang' || {_SEP} || 'source' || chr(10) ELSE '' END
  || doc_id || {_SEP} || lang || {_SEP} || source || chr(10) || n_chars || {_SEP} || lang || {_SEP} || 'a b' || chr(10) || chr(10) || source || {_SEP} || lang AS txt FROM documents"""
_ROWS_SQL = """WITH files AS (%s),
  rows AS (SELECT doc_id, list_filter(string_split(txt, chr(10)), lambda x: trim(x) <> '') AS w FROM files),
  seps AS (SELECT doc_id, w, coalesce(list_filter([',', ';', chr(9), '|'], lambda s: len(string_split(w[1], s)) > 1)[1], '') AS sep FROM rows),
  cells AS (SELECT doc_id, w, sep, CASE WHEN sep = '' THEN [w[1]] ELSE string_split(w[1], sep) END AS c FROM seps),
  heads AS (SELECT *, len(list_filter(c, lambda x: trim(x) = '' OR regexp_full_match(trim(x), '[0-9.]+'))) = 0 AND len(list_distinct(c)) = len(c) AS header FROM cells),
  each AS (SELECT *, unnest(range(1, least(len(w) - header::int, 2) + 1))::int AS row_no FROM heads)
SELECT doc_id, nullif(sep, '') AS sep, header, len(c)::int AS n_columns,
  CASE WHEN header THEN array_to_string(c, '/') ELSE array_to_string(list_transform(range(len(c)), lambda i: 'column_' || i), '/') END AS names, row_no,
  array_to_string(CASE WHEN sep = '' THEN [w[row_no + header::int]] ELSE string_split(w[row_no + header::int], sep) END, '/') AS cells FROM each""" % _FILES


@query("preview", _ROWS_SQL)
def preview(spark, sf):
    """First rows of small files in the dialect found for each of them."""
    sep = F.expr(_SEP.replace("chr(9)", "'\\t'"))
    cells = lambda *c: F.concat_ws("~~", *c)
    head = F.when(F.col("doc_id") % 2 == 0, F.lit("id~~lang~~source\n")).otherwise(F.lit(""))
    body = F.concat(cells("doc_id", "lang", "source"), F.lit("\n"), cells("n_chars", "lang", F.lit("a b")), F.lit("\n\n"), cells("source", "lang"))
    files = views.documents(spark, sf).select("doc_id", F.replace(F.concat(head, body), F.lit("~~"), sep).alias("txt"))
    p = csv.preview_files(files, "txt", ["doc_id"], rows=2)
    return p.select("doc_id", "sep", "header", F.size("names").alias("n_columns"), F.array_join("names", "/").alias("names"), "row_no", F.array_join("cells", "/").alias("cells"))
