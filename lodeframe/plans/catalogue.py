"""The catalogue of queries, each with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, geometry, provider, text
from ..functions.intent import PROFILE_WORDS, TEXT_WORDS, VISUAL_WORDS, intent, profile
from ..operators import cache, detect, render, route, sandbox, sections
from ..settings import Settings
from ..sources.backends import FakeOcr, FakePdf, TellingVision
from ..sources.convert import convert, decode_texts
from ..sources.files import text_files
from ..sources.imaging import FakeCodec
from ..sources.logs import log_lines
from ..sources.transport import FakeTransport, HttpVision, Reply
from ..staging import shared_folder
from ..streaming.windows import first_sightings, run_to_table, window_counts
from .engine import Engine, requests_for
from .facts import verdicts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pick(values, index) -> "F.Column":
    """The entry of a short list that a column chooses, from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# -- detection and sources ---------------------------------------------------

EXTENSIONS = [*detect.EXTENSIONS, ".bin", ""]
DIM = ", ".join(f"('{e}', '{c}')" for e, (_, c) in detect.EXTENSIONS.items())


@query(f"""
    WITH files AS (SELECT doc_id AS id, octet_length(encode(text)) AS bytes FROM documents UNION ALL SELECT page_id, octet_length(encode(html)) FROM pages),
    named AS (SELECT bytes, {sql_list(EXTENSIONS)}[id % {len(EXTENSIONS)} + 1] AS extension FROM files),
    dim(extension, category) AS (VALUES {DIM})
    SELECT coalesce(category, 'unknown') AS category, count(*) AS n_files, sum(bytes)::BIGINT AS n_bytes, coalesce(category, 'unknown') IN ('archive', 'audio', 'unknown') AS refused
    FROM named LEFT JOIN dim USING (extension) GROUP BY 1, 4
""")
def q01_detect_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("bytes"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.octet_length("html").alias("bytes"))
    named = docs.union(pages).select("bytes", pick(EXTENSIONS, F.col("id") % len(EXTENSIONS)).alias("extension"))
    found = named.join(F.broadcast(detect.extension_table(spark)), "extension", "left").withColumn("category", F.coalesce("ext_category", F.lit("unknown")))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("n_bytes")).withColumn("refused", detect.refusal(F.col("category")).isNotNull())


HEADS = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "424D", "49492A00", "4D4D002A", "255044462D312E37", "D0CF11E0A1B11AE1", "5249464600000000" + "57454250", "504B0304", "", "EFBBBF"]
SNIFFED = "CASE WHEN h LIKE '52494646________57454250%' THEN 'webp' " + " ".join(f"WHEN h LIKE '{s}%' THEN '{k}'" for s, k, _ in detect.SIGNATURES) + " WHEN h LIKE '504B%' THEN 'zip' END"


@query(f"""
    WITH heads AS (SELECT doc_id, ({sql_list(EXTENSIONS)})[doc_id % 7 + 1] AS extension, left(({sql_list(HEADS)})[doc_id % {len(HEADS)} + 1] || hex(encode(left(text, 16))), 32) AS h FROM documents),
    seen AS (SELECT extension, {SNIFFED} AS sniffed FROM heads),
    merged AS (SELECT sniffed, CASE WHEN sniffed IN ('png', 'jpeg', 'gif', 'bmp', 'tiff', 'webp') THEN 'image' WHEN sniffed = 'pdf' THEN 'pdf' WHEN sniffed = 'zip' THEN 'archive' ELSE 'image' END AS category FROM seen)
    SELECT coalesce(sniffed, 'none') AS sniffed, category, count(*) AS n FROM merged GROUP BY 1, 2
""")
def q02_magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = F.substring(F.concat(pick(HEADS, F.col("doc_id") % len(HEADS)), F.hex(F.substring("text", 1, 16).cast("binary"))), 1, 32)
    files = docs.select(pick(EXTENSIONS, F.col("doc_id") % 7).alias("extension"), head.alias("head"))
    found = detect.detect(files, F.col("head"))
    return found.groupBy(F.coalesce("sniffed_type", F.lit("none")).alias("sniffed"), "category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def q03_content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("""
    SELECT CASE WHEN octet_length(encode(text)) <= 4096 THEN 'ok' ELSE 'FILE_TOO_LARGE' END AS status, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1
""")
def q04_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    docs = table(spark, sf_dir, "documents").select(size.alias("size"), F.when(size <= 4096, "ok").otherwise("FILE_TOO_LARGE").alias("status"))
    return docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


# -- texts -------------------------------------------------------------------

SQL_LINES = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)"
SQL_SUMMARY = f"'Plain-text file `' || doc_id || '.txt` (' || {SQL_LINES} || ' line' || CASE WHEN {SQL_LINES} = 1 THEN '' ELSE 's' END || ', ' || format('{{:,}}', length(text)) || ' characters, utf-8-sig).'"
SQL_SPLIT = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
SQL_ALL_LINES = f"CASE WHEN text = '' THEN [] WHEN {SQL_SPLIT}[-1] = '' THEN {SQL_SPLIT}[:-2] ELSE {SQL_SPLIT} END"
SQL_HEAD = "array_to_string(CASE WHEN len(ls) > 12 THEN list_append(ls[1:12], '... (' || (len(ls) - 12) || ' more lines)') ELSE ls END, chr(10))"


def file_name(id_col: str = "doc_id") -> "F.Column":
    return F.concat(F.col(id_col).cast("string"), F.lit(".txt"))


@query(f"SELECT doc_id, {SQL_LINES}::BIGINT AS lines, length(text)::BIGINT AS chars, {SQL_SUMMARY} AS summary FROM documents")
def q05_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, t = table(spark, sf_dir, "documents"), F.col("text")
    return docs.select("doc_id", text.line_count(t).alias("lines"), F.length(t).cast("long").alias("chars"), text.text_summary(file_name(), t).alias("summary"))


@query(f"WITH d AS (SELECT doc_id, {SQL_ALL_LINES} AS ls FROM documents) SELECT doc_id, len(ls)::BIGINT AS n_lines, sha256({SQL_HEAD}) AS head FROM d")
def q06_head_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(t)).cast("long").alias("n_lines"), F.sha2(text.first_lines(t, 12), 256).alias("head"))


@query("""
    WITH t AS (SELECT 'document' AS kind, doc_id AS id, text || chr(10) || repeat('`', (doc_id % 9)::INT) AS t FROM documents
               UNION ALL SELECT 'turn', conv_id * 1000 + turn, repeat('`', (turn % 3)::INT) || text FROM conversations),
    f AS (SELECT kind, id, t, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1) AS n FROM t)
    SELECT kind, id, n::BIGINT AS fence, (2 * n + length('text') + 2 + length(t))::BIGINT AS fenced_chars FROM f
""")
def q07_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.concat("text", F.lit("\n"), F.expr("repeat('`', cast(doc_id % 9 as int))")).alias("t"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), F.concat(F.expr("repeat('`', cast(turn % 3 as int))"), "text"))
    return docs.union(turns).select("kind", "id", text.fence_length(F.col("t")).cast("long").alias("fence"), F.length(text.fenced(F.col("t"))).cast("long").alias("fenced_chars"))


SQL_STRIP = r"regexp_replace({}, '^[\s\x1c-\x1f\x{{85}}\x{{a0}}]+|[\s\x1c-\x1f\x{{85}}\x{{a0}}]+$', '', 'g')"
SQL_PRINTABLE = r"length(regexp_replace({}, '[^\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}} \n\r\t]', '', 'g'))"


@query(f"""
    WITH p AS (SELECT lang, {SQL_STRIP.format("text")} AS t FROM documents),
    w AS (SELECT lang, length(t) AS n, length(t) < 120 OR (CASE WHEN length(t) = 0 THEN 0 ELSE {SQL_PRINTABLE.format("t")} / length(t) END) < 0.6 AS weak FROM p)
    SELECT lang, count(*) AS pages, count(*) FILTER (weak) AS weak_pages, sum(n)::BIGINT AS chars FROM w GROUP BY lang
""")
def q08_printable_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "documents").select("lang", text.strip(F.col("text")).alias("t"))
    weak = clean.withColumn("weak", text.needs_fallback(F.length("t"), text.printable_ratio(F.col("t"))))
    return weak.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.count_if("weak").alias("weak_pages"), F.sum(F.length("t")).cast("long").alias("chars"))


PAGES = ["1", "1-3", "1,3,7", " 2 , 4-5 ", "3,1-2,2", "", None, " ", ",", "0", "0-2", "5-2", "a", "1-b", "1--2", "-4", "4-", "1-9999999999", "12345678901234567890", "7", "1-3,2-6", "2,,3", "1 - 2", "1.5"]


@query(f"""
    WITH r AS (SELECT doc_id, ({sql_list(PAGES)})[doc_id % {len(PAGES)} + 1] AS e, doc_id % 10 AS total FROM documents),
    t AS (SELECT *, list_filter(list_transform(string_split(e, ','), lambda x: trim(x)), lambda x: x <> '') AS ts FROM r),
    c AS (SELECT *, list_filter(list_transform(ts, lambda x: CASE WHEN contains(x, '-') THEN CASE WHEN NOT regexp_full_match(x, '[0-9]+\\s*-\\s*[0-9]+') THEN 'MALFORMED_RANGE'
              WHEN regexp_extract(x, '^[0-9]+')::HUGEINT > regexp_extract(x, '[0-9]+$')::HUGEINT THEN 'BACKWARDS' END
              WHEN NOT regexp_full_match(x, '[0-9]+') THEN 'NOT_A_NUMBER' END), lambda x: x IS NOT NULL) AS errors FROM t),
    b AS (SELECT *, CASE WHEN total <= 0 THEN 'ZERO_PAGES' WHEN e IS NULL OR trim(e) = '' THEN NULL WHEN len(errors) > 0 THEN errors[1] WHEN len(ts) = 0 THEN 'NOTHING_SELECTED'
              WHEN list_min(list_transform(ts, lambda x: regexp_extract(x, '^[0-9]+')::HUGEINT)) < 1 THEN 'BELOW_ONE'
              WHEN list_max(list_transform(ts, lambda x: regexp_extract(x, '[0-9]+$')::HUGEINT)) > total THEN 'OUT_OF_RANGE' END AS error FROM c)
    SELECT doc_id, error, CASE WHEN error IS NOT NULL THEN NULL WHEN e IS NULL OR trim(e) = '' THEN array_to_string(list_slice(range(1, total + 1), 1, 6), ',')
        ELSE array_to_string(list_slice(list_sort(list_distinct(flatten(list_transform(ts, lambda x: range(regexp_extract(x, '^[0-9]+')::BIGINT, regexp_extract(x, '[0-9]+$')::BIGINT + 1))))), 1, 6), ',') END AS pages FROM b
""")
def q09_page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", pick(PAGES, F.col("doc_id") % len(PAGES)).alias("e"), (F.col("doc_id") % 10).cast("int").alias("total"))
    chosen = docs.withColumn("sel", text.page_selection(F.col("e"), F.col("total"), 6))
    return chosen.select("doc_id", "sel.error", F.array_join("sel.pages", ",").alias("pages"))


# -- questions and routes ----------------------------------------------------

EDGE = r"(^|[^\p{{L}}\p{{N}}_\p{{M}}])({})($|[^\p{{L}}\p{{N}}_\p{{M}}])"


def sql_spoken(column: str, words) -> str:
    return f"regexp_matches({column}, '(?is)" + EDGE.format("|".join(words)) + "')"


SQL_INTENT = f"CASE WHEN {sql_spoken('text', VISUAL_WORDS)} THEN 'visual_semantics' WHEN {sql_spoken('text', TEXT_WORDS)} THEN 'text_extraction' ELSE 'unknown' END"
SQL_PROFILE = "CASE " + " ".join(f"WHEN {sql_spoken('text', w)} THEN '{k}'" for k, w in PROFILE_WORDS.items()) + " ELSE 'general' END"
ASKS = ["", "Why is the button disabled? ", "Please read the exact error ", "Transcribe the code. ", "Compare the trend in this chart: ", "What does the screen say? ", "Extract the table. ", "Look right to you? "]
SQL_ASKED = f"(SELECT conv_id, turn, ({sql_list(ASKS)})[(conv_id + turn) % {len(ASKS)} + 1] || text AS text FROM conversations WHERE role = 'user')"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", F.concat(pick(ASKS, (F.col("conv_id") + F.col("turn")) % len(ASKS)), "text").alias("text"))


@query(f"SELECT {SQL_INTENT} AS intent, count(*) AS n FROM {SQL_ASKED} GROUP BY 1")
def q10_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).groupBy(intent(F.col("text")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {SQL_PROFILE} AS profile, count(*) AS n FROM {SQL_ASKED} GROUP BY 1")
def q11_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).groupBy(profile(F.col("text")).alias("profile")).agg(F.count(F.lit(1)).alias("n"))


SQL_BLIND = "CASE WHEN NOT configured THEN 'VISION_NOT_CONFIGURED' ELSE 'CLOUD_VISION_DISABLED' END"


@query(f"""
    WITH m AS (SELECT unnest({sql_list(route.MODES)}) AS mode), c AS (SELECT unnest({sql_list(detect.CATEGORIES)}) AS category), s AS (SELECT unnest({sql_list(route.STRATEGIES)}) AS strategy),
    i AS (SELECT unnest(['visual_semantics', 'text_extraction', 'unknown']) AS intent), b AS (SELECT unnest([false, true]) AS x),
    g AS (SELECT mode, category, strategy, intent, o.x AS ocr, v.x AS configured, a.x AS allowed, v.x AND a.x AS usable FROM m, c, s, i, b o, b v, b a),
    d AS (SELECT *, CASE
        WHEN mode = 'vision' AND NOT usable THEN {SQL_BLIND}
        WHEN mode IN ('ocr', 'vision') AND category NOT IN ('image', 'pdf') THEN 'MODE_NOT_APPLICABLE'
        WHEN mode = 'ocr' AND NOT ocr THEN 'OCR_NOT_CONFIGURED'
        WHEN mode = 'document' AND category = 'image' THEN 'MODE_NOT_APPLICABLE'
        WHEN category IN ('audio', 'archive', 'unknown') THEN 'MODE_NOT_APPLICABLE'
        WHEN mode = 'auto' AND category = 'image' AND NOT ocr AND NOT usable THEN {SQL_BLIND} END AS error FROM g)
    SELECT mode, category, strategy, intent, ocr, configured, allowed, error,
        CASE WHEN error IS NULL THEN CASE WHEN category IN ('image', 'pdf', 'text') THEN category ELSE 'convert' END END AS processor,
        CASE WHEN error IS NOT NULL THEN NULL WHEN category = 'text' THEN 'text' WHEN category NOT IN ('image', 'pdf') THEN 'convert'
             WHEN category = 'pdf' THEN CASE mode WHEN 'document' THEN 'text' ELSE mode END
             WHEN mode = 'ocr' THEN 'ocr_only' WHEN mode = 'vision' THEN 'vision'
             WHEN strategy = 'ocr_first' OR NOT usable THEN CASE WHEN NOT ocr THEN 'vision' WHEN usable THEN 'hybrid' ELSE 'ocr_only' END
             WHEN strategy = 'vision_first' THEN 'vision' ELSE 'hybrid' END AS plan,
        error IS NULL AND mode = 'auto' AND category = 'image' AND NOT usable AND ocr AND intent = 'visual_semantics' AS warned FROM d
""")
def q12_route_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision table: fixed, and independent of the data."""
    import itertools

    rows = list(itertools.product(route.MODES, detect.CATEGORIES, route.STRATEGIES, ("visual_semantics", "text_extraction", "unknown"), (False, True), (False, True), (False, True)))
    grid = spark.createDataFrame(rows, "mode string, category string, strategy string, intent string, ocr boolean, configured boolean, allowed boolean")
    chosen = grid.withColumn("r", route.route(*[F.col(c) for c in ("mode", "category", "ocr", "configured", "allowed", "strategy", "intent")]))
    return chosen.select("mode", "category", "strategy", "intent", "ocr", "configured", "allowed", "r.error", "r.processor", "r.plan", "r.warned")


# -- cache -------------------------------------------------------------------


def sql_key() -> str:
    s = Settings()
    fields = {
        "schema": "'2'", "sha256": "sha256(d.text)", "mode": "'auto'", "vision_profile": "'general'", "detail": "'normal'", "pages": "'1,3-5'",
        "question": r"sha256(trim(regexp_replace(lower(t.text), '[\s\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g')))", "processor": "'text'", "processor_version": "'1'", "extension": "'.txt'", "prompt_version": "'2'", "ocr_version": "''", "vision_base_url": "''",
    }
    for name in ("max_pages", "ocr_backend", "ocr_languages", "send_ocr_to_cloud", "vision_provider", "model", "vision_route", "vision_max_output_tokens", "allow_cloud_vision", "auto_image_strategy", "pdf_min_chars_per_page", "pdf_render_dpi", "vision_max_dimension", "vision_max_image_bytes", "vision_image_format", "max_image_pixels"):
        fields[name] = f"'{getattr(s, name)}'"
    return "sha256(" + " || chr(31) || ".join(f"'{k}=' || {fields[k]}" for k in sorted(fields)) + ")"


@query(f"SELECT t.conv_id, t.turn, {sql_key()} AS cache_key FROM conversations t JOIN documents d ON d.doc_id = t.conv_id WHERE t.role = 'user'")
def q13_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = turns.join(docs, F.col("conv_id") == F.col("doc_id"))
    lit = F.lit
    key = cache.cache_key(Settings(), sha256=F.col("sha256"), mode=lit("auto"), profile=lit("general"), detail=lit("normal"), pages=lit("1, 3-5 ,"), question=F.col("text"), processor=lit("text"), processor_version=lit("1"), extension=lit(".txt"))
    return rows.select("conv_id", "turn", key.alias("cache_key"))


def entries_of(events: DataFrame) -> DataFrame:
    """Users as cache entries: stored at each purchase."""
    bought = events.where("event_type = 'purchase'")
    return bought.select(F.sha2(F.col("user_id").cast("string"), 256).alias("cache_key"), F.lit(2).alias("schema_version"), F.col("ts").cast("timestamp").alias("stored_at"), F.col("event_id").cast("string").alias("payload"))


@query("""
    WITH e AS (SELECT sha256(user_id::VARCHAR) AS k, max(ts) AS stored FROM events WHERE event_type = 'purchase' GROUP BY 1),
    n AS (SELECT max(ts) AS now FROM events)
    SELECT event_type, CASE WHEN stored IS NULL THEN 'miss' WHEN epoch(now)::BIGINT - epoch(stored)::BIGINT <= 3 * 86400 THEN 'hit' ELSE 'expired' END AS status, count(*) AS n
    FROM events LEFT JOIN e ON k = sha256(user_id::VARCHAR), n GROUP BY 1, 2
""")
def q14_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").cast("timestamp")).first()[0]
    asked_for = events.select("event_type", F.sha2(F.col("user_id").cast("string"), 256).alias("cache_key"))
    found = cache.lookup(asked_for, entries_of(events), F.lit(now), 3)
    return found.groupBy("event_type", F.col("cache_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH e AS (SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS size_bytes, max(ts) AS last_access FROM events GROUP BY 1),
    w AS (SELECT *, sum(size_bytes) OVER () - coalesce(sum(size_bytes) OVER (ORDER BY last_access, size_bytes, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1000000 AS evicted FROM e)
    SELECT user_id, size_bytes, evicted FROM w
""")
def q15_lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("size_bytes"), F.max("ts").cast("timestamp").alias("last_access"))
    return cache.evict(entries, 1_000_000, order=("last_access", "size_bytes", "user_id")).select("user_id", "size_bytes", "evicted")


@query("""
    WITH l AS (SELECT doc_id, list_concat(string_split(lower(text), ' '), string_split(text, ' ')) AS l FROM documents),
    w AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l),
    f AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY 1, 2)
    SELECT doc_id, sha256(string_agg(x, '|' ORDER BY i)) AS kept FROM f GROUP BY 1
""")
def q16_dedup_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text twice over as warnings: its words in lower case, then as they are."""
    first, second = F.split(F.lower("text"), " "), F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(text.ordered_union(first, second), "|"), 256).alias("kept"))


# -- rendering ---------------------------------------------------------------

SQL_NOTICE = "'" + text.CUT_NOTICE.replace("\n", "' || chr(10) || '") + "'"


def sql_truncate(body: str, limit: int) -> str:
    window = f"reverse(substr({body}, {limit - 199}, 200))"
    cut = f"CASE WHEN instr({window}, chr(10)) > 0 THEN {limit} - instr({window}, chr(10)) ELSE {limit} END"
    return f"CASE WHEN length({body}) <= {limit} THEN {body} ELSE regexp_replace(left({body}, ({cut})::INT), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '') || {SQL_NOTICE} END"


@query(f"WITH c AS (SELECT doc_id, length(text) > 600 AS truncated, {sql_truncate('text', 600)} AS m FROM documents) SELECT doc_id, truncated, length(m)::BIGINT AS returned_chars, sha256(m) AS sha FROM c")
def q17_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), F.lit(600)).alias("c"))
    return cut.select("doc_id", "c.truncated", "c.returned_chars", F.sha2("c.markdown", 256).alias("sha"))


def chunk_evidence() -> "F.Column":
    """The whole text in pieces of 1,000 characters as evidence."""
    n = F.ceil(F.length("text") / 1000).cast("int")
    piece = lambda k: F.struct(F.lit("text").alias("type"), F.concat(F.lit("part "), k.cast("string")).alias("location"), F.substring(F.col("text"), (k - 1) * 1000 + 1, F.lit(1000)).alias("content"), F.lit(None).cast("double").alias("confidence"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), piece).cast(render.EVIDENCE)).otherwise(F.array().cast(render.EVIDENCE))


@query("""
    WITH d AS (SELECT doc_id, text, unnest(['compact', 'normal', 'full']) AS detail, ceil(length(text) / 1000)::INT AS n, CASE WHEN doc_id % 3 = 0 THEN 'an answer' END AS answer, CASE WHEN doc_id % 2 = 0 THEN 'a summary' ELSE '' END AS summary FROM documents),
    e AS (SELECT *, list_transform(range(1, n + 1), lambda k: length(substr(text, ((k - 1) * 1000 + 1)::BIGINT, 1000))) AS sizes FROM d)
    SELECT doc_id, detail,
        length(CASE WHEN detail = 'compact' THEN coalesce(answer, nullif(summary, ''), left(text, 1500)) ELSE text END)::BIGINT AS content_chars,
        (CASE WHEN detail = 'compact' THEN least(3, n) ELSE n END)::BIGINT AS n_evidence,
        coalesce(list_sum(CASE detail WHEN 'compact' THEN list_transform(sizes[1:3], lambda x: least(x, 400)) WHEN 'normal' THEN list_transform(sizes, lambda x: least(x, 800)) ELSE sizes END), 0)::BIGINT AS evidence_chars
    FROM e
""")
def q18_detail_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", chunk_evidence().alias("evidence"), F.explode(F.array(*map(F.lit, ("compact", "normal", "full")))).alias("detail"))
    answer, summary = F.when(F.col("doc_id") % 3 == 0, "an answer"), F.when(F.col("doc_id") % 2 == 0, "a summary").otherwise("")
    shaped = docs.select("doc_id", "detail", render.shaped_content(F.col("text"), summary, answer, F.col("detail")).alias("content"), render.shaped_evidence(F.col("evidence"), F.col("detail")).alias("shown"))
    return shaped.select("doc_id", "detail", F.length("content").cast("long").alias("content_chars"), F.size("shown").cast("long").alias("n_evidence"), F.aggregate("shown", F.lit(0), lambda a, e: a + F.length(e["content"])).cast("long").alias("evidence_chars"))


SQL_FENCED = "repeat('`', f) || 'text' || chr(10) || text || chr(10) || repeat('`', f)"
SQL_ANALYZED = rf"""
    WITH l AS (SELECT doc_id, text, {SQL_SUMMARY} AS summary, {SQL_LINES} AS n, {SQL_ALL_LINES} AS ls, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)::INT AS f FROM documents),
    b AS (SELECT doc_id, {SQL_STRIP.format("left(" + SQL_HEAD + ", 800)")} AS ev, summary, n, {SQL_FENCED} AS content FROM l),
    m AS (SELECT doc_id, '## Summary' || chr(10) || chr(10) || summary || chr(10) || chr(10) || '## Extracted content' || chr(10) || chr(10) || content || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10)
        || '- **text** (' || CASE WHEN n > 0 THEN 'lines 1-' || n ELSE 'empty file' END || '):' || CASE WHEN contains(ev, chr(10)) THEN chr(10) || chr(10) || '  ' ELSE ' ' END || ev AS body FROM b)
"""


@query(SQL_ANALYZED + f", t AS (SELECT doc_id, {sql_truncate('body', 4000)} AS m, length(body) > 4000 AS cut FROM m) SELECT doc_id, sha256(m) AS sha, length(m)::BIGINT AS chars, cut AS truncated FROM t")
def q19_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyze_documents(spark, sf_dir, max_chars=4000)
    return out.select(F.regexp_extract("request_id", "([0-9]+)", 1).cast("long").alias("doc_id"), F.sha2("markdown", 256).alias("sha"), F.length("markdown").cast("long").alias("chars"), F.col("truncation").isNotNull().alias("truncated"))


def analyze_documents(spark: SparkSession, sf_dir: str, max_chars: int = 100_000) -> DataFrame:
    """One request for each document through the whole engine."""
    files = text_files(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    return Engine(spark).analyze(requests_for(files.select("path"), max_chars=max_chars), files)


# -- sections ----------------------------------------------------------------


def headed(marker: Callable) -> "F.Column":
    """All lines of the document, some of them made headings by ``marker``."""
    return F.array_join(F.transform(F.split("text", "\n"), marker), "\n")


@query(r"""
    WITH h AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 1 AND x <> '' THEN repeat('#', ((i + doc_id) % 8)::INT) || ' ' || x ELSE x END), chr(10)) AS md FROM documents),
    o AS (SELECT doc_id, list_transform(regexp_extract_all(md, '(?m)^#{1,6}[ \t]+\S[^\n]*$'), lambda x: regexp_replace(regexp_replace(x, '^(#+)[ \t]+', '\1 '), '[\s\x1c-\x1f\x{85}\x{a0}]+$', '')) AS hs FROM h)
    SELECT doc_id, least(len(hs), 12)::BIGINT AS n, sha256(array_to_string(hs[1:12], chr(10))) AS outline FROM o
""")
def q20_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = headed(lambda x, i: F.when(((i + 1) % 3 == 1) & (x != ""), F.concat(F.repeat(F.lit("#"), ((i + 1 + F.col("doc_id")) % 8).cast("int")), F.lit(" "), x)).otherwise(x))
    found = table(spark, sf_dir, "documents").select("doc_id", sections.outline(md).alias("hs"))
    return found.select("doc_id", F.size("hs").cast("long").alias("n"), F.sha2(F.array_join("hs", "\n"), 256).alias("outline"))


@query(r"""
    WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws, doc_id % 5 + 1 AS k FROM documents),
    n AS (SELECT *, greatest(1, ceil(len(ws) / k))::INT AS per FROM w),
    s AS (SELECT doc_id, k, list_transform(range(1, k + 1), lambda i: array_to_string(ws[((i - 1) * per + 1)::INT:(i * per)::INT], ' ')) AS bodies FROM n)
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE k END AS n_slides, CASE WHEN doc_id % 4 = 3 THEN sha256('') ELSE sha256(array_to_string(list_transform(bodies, lambda x: regexp_replace(x, '^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$', '', 'g')), '|')) END AS bodies FROM s
""")
def q21_split_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, cut into marked slides of equal length; in every fourth the last number is wrong, and nothing of it may be trusted."""
    k, words, per = (F.col("doc_id") % 5 + 1).cast("int"), F.col("words"), F.col("per")
    number = lambda i: F.when((F.col("doc_id") % 4 == 3) & (i == k), i + 1).otherwise(i)
    body = lambda i: F.array_join(F.slice(words, (i - 1) * per + 1, per), " ")
    md = F.array_join(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("<!-- Slide number: "), number(i).cast("string"), F.lit(" -->\n"), body(i))), "\n\n")
    cut = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda x: x != "").alias("words"))
    cut = cut.withColumn("per", F.greatest(F.lit(1), F.ceil(F.size("words") / k)).cast("int"))
    found = cut.select("doc_id", sections.split_slides(md, k).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_slides"), F.sha2(F.array_join(F.transform("s", lambda x: x["body"]), "|"), 256).alias("bodies"))


@query("""
    WITH s AS (SELECT c_custkey AS id, c_custkey % 3 + 1 AS k, c_custkey % 5 = 0 AS wrong FROM customer)
    SELECT id, CASE WHEN wrong THEN 0 ELSE k END AS n_sheets, CASE WHEN wrong THEN '' ELSE array_to_string(list_transform(range(1, k + 1), lambda i: 'Sheet ' || i || '=' || (id * i)), ';') END AS sheets FROM s
""")
def q22_split_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("id") % 3 + 1).cast("int")
    md = F.array_join(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("## Sheet "), i.cast("string"), F.lit("  \n\n| "), (F.col("id") * i).cast("string"), F.lit(" |"))), "\n\n")
    names = F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("Sheet "), F.when((F.col("id") % 5 == 0) & (i == k), F.lit("x")).otherwise(i.cast("string"))))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", sections.split_sheets(md, names).alias("s"))
    shown = F.transform("s", lambda x: F.concat(x["name"], F.lit("="), F.regexp_extract(x["body"], "([0-9]+)", 1)))
    return found.select("id", F.size("s").cast("long").alias("n_sheets"), F.array_join(shown, ";").alias("sheets"))


def pipe_row(*columns) -> "F.Column":
    cells = [F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


@query("SELECT n_nationkey AS id, '| ' || n_nationkey || ' | ' || n_name || ' | ' || r_name || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -2, '| key | nation | region |' UNION ALL SELECT -1, '| --- | --- | --- |'")
def q23_table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    head = spark.createDataFrame([(-2, "| key | nation | region |"), (-1, "| --- | --- | --- |")], "id int, line string")
    return head.union(rows.select(F.col("n_nationkey").alias("id"), pipe_row(F.col("n_nationkey"), F.col("n_name"), F.col("r_name")).alias("line")))


@query(r"""
    SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<h[1-6][\s>]'))::BIGINT AS headings, len(regexp_extract_all(html, '(?i)<a\s[^>]*href'))::BIGINT AS links, len(regexp_extract_all(html, '(?i)<li[\s>]'))::BIGINT AS items FROM pages
""")
def q24_html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), count(r"(?i)<h[1-6][\s>]").alias("headings"), count(r"(?i)<a\s[^>]*href").alias("links"), count(r"(?i)<li[\s>]").alias("items"))


@query()
def q24_html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown; tests/test_engine.py and tests/test_operators.py hold the converters against fixtures."""
    files = text_files(table(spark, sf_dir, "pages"), id_col="page_id", text_col="html", extension=".html")
    return convert(files).select("name", "markdown", F.length("markdown").cast("long").alias("chars"))


@query(r"""
    WITH t AS (SELECT conv_id, turn, regexp_replace(replace(replace(text, chr(10), ' '), '`', ''), '^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$', '', 'g') AS b, turn % 4 AS kind FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, kind <> 3 AS structured, CASE WHEN kind < 2 AND b <> '' THEN b END AS answer,
        (CASE WHEN kind = 3 THEN 0 ELSE 2 END)::BIGINT AS n_observations, (CASE WHEN kind = 1 THEN 1 ELSE 0 END)::BIGINT AS n_uncertain, sha256(left(CASE WHEN kind < 2 AND b <> '' THEN b WHEN kind = 3 THEN 'plain ' || b ELSE 'one' END, 600)) AS summary FROM t
""")
def q25_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    b = text.strip(F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("`"), F.lit("")))
    seen = F.lit("## DIRECT OBSERVATIONS\n- one\n- two\n")
    kind = F.col("turn") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("## ANSWER\n"), b, F.lit("\n\n"), seen))
        .when(kind == 1, F.concat(seen, F.lit("\n**UNCERTAINTY**\nperhaps\n\nanswer:\n"), b))
        .when(kind == 2, seen)
        .otherwise(F.concat(F.lit("plain "), b))
    )
    parsed = turns.select("conv_id", "turn", reply.alias("reply")).withColumn("p", provider.parse_reply(F.col("reply")))
    return parsed.select("conv_id", "turn", "p.structured", "p.answer", F.size("p.observations").cast("long").alias("n_observations"), F.size("p.uncertainties").cast("long").alias("n_uncertain"), F.sha2("p.summary", 256).alias("summary"))


# -- geometry, quality, providers -------------------------------------------


@query("""
    WITH s AS (SELECT o_orderkey AS id, (o_orderkey * 37) % 9000 + 10 AS w, (o_orderkey * 91) % 15000 + 10 AS h FROM orders),
    g AS (SELECT *, greatest(w, h) AS l, least(w, h) AS m, greatest(1, ceil((greatest(w, h) - 96) / 4000.0))::INT AS n FROM s),
    p AS (SELECT *, CASE WHEN l <= 4096 THEN 'as_is' WHEN l / m >= 2.5 AND m <= 4096 AND n <= 4 THEN 'tiles' ELSE 'downscale' END AS plan FROM g)
    SELECT id, plan, (CASE WHEN plan = 'tiles' THEN n ELSE 0 END)::BIGINT AS n_tiles,
        (CASE WHEN plan = 'tiles' THEN least((n - 1) * 4000 + 4096, l) - (n - 1) * 4000 ELSE 0 END)::BIGINT AS last_tile,
        greatest(1, round_even(w * least(1.0, 4096.0::DOUBLE / l), 0))::BIGINT AS scaled_w, greatest(1, round_even(h * least(1.0, 4096.0::DOUBLE / l), 0))::BIGINT AS scaled_h FROM p
""")
def q26_tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 37) % 9000 + 10).cast("int").alias("w"), ((F.col("o_orderkey") * 91) % 15000 + 10).cast("int").alias("h"))
    w, h, limit = F.col("w"), F.col("h"), 4096
    planned = sizes.select("id", geometry.payload_plan(w, h, limit).alias("plan"), geometry.tiles(w, h, limit).alias("t"), geometry.scaled(w, h, limit).alias("s"))
    last = F.element_at("t", -1)
    along = F.when(last["x"] > 0, last["w"]).when(last["y"] > 0, last["h"]).otherwise(0)
    return planned.select("id", "plan", F.size("t").cast("long").alias("n_tiles"), F.when(F.size("t") > 0, along).otherwise(0).cast("long").alias("last_tile"), F.col("s.w").cast("long").alias("scaled_w"), F.col("s.h").cast("long").alias("scaled_h"))


@query("""
    WITH w AS (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE (event_id * 13) % 101 END AS conf FROM events),
    m AS (SELECT user_id, count(*) AS words, count(*) FILTER (conf >= 0) AS counted, sum(conf) FILTER (conf >= 0) / nullif(count(*) FILTER (conf >= 0), 0) / 100.0 AS c FROM w GROUP BY 1)
    SELECT user_id, words, counted, words * 5 >= 40 AND (c IS NULL OR c >= 0.65) AS sufficient FROM m
""")
def q27_ocr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("event_id") % 7 == 0, -1).otherwise((F.col("event_id") * 13) % 101)
    words = table(spark, sf_dir, "events").select("user_id", conf.alias("conf"))
    means = words.groupBy("user_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("conf") >= 0).alias("counted"), (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("c"))
    return means.select("user_id", "words", "counted", text.ocr_good_enough(F.col("words") * 5, F.col("c")).alias("sufficient"))


STATUSES = [400, 401, 402, 403, 404, 408, 409, 410, 425, 429, 500, 502, 503, 504, 418]
BODIES = ["", "monthly Quota used up", "out of CREDIT", "slow down", None]
SQL_STATUS = " ".join(f"WHEN s = {k} THEN '{c}'" for k, (c, _) in provider.STATUS.items())


@query(f"""
    WITH x AS (SELECT event_id, ([{", ".join(map(str, STATUSES))}])[event_id % {len(STATUSES)} + 1] AS s, ({sql_list(BODIES)})[event_id % {len(BODIES)} + 1] AS b FROM events)
    SELECT CASE WHEN s = 429 AND regexp_matches(lower(coalesce(b, '')), 'quota|credit') THEN 'VISION_QUOTA_EXCEEDED' {SQL_STATUS} ELSE 'VISION_PROVIDER_ERROR' END AS code, s IN (408, 409, 425, 502, 503, 504) AS retryable, count(*) AS n FROM x GROUP BY 1, 2
""")
def q28_http_error_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seen = events.select(provider.http_error(pick(STATUSES, F.col("event_id") % len(STATUSES)), pick(BODIES, F.col("event_id") % len(BODIES))).alias("e"))
    return seen.groupBy("e.code", "e.retryable").agg(F.count(F.lit(1)).alias("n"))


KEYS = ["api_key", "ApiKey", "x-authorization", "TOKEN", "client_secret", "password_hash", "Bearer", "name", "user", "tok"]


@query(f"""
    WITH k AS (SELECT event_id, ({sql_list(KEYS)})[event_id % {len(KEYS)} + 1] AS k, event_type AS v FROM events)
    SELECT event_id, k AS key, CASE WHEN regexp_matches(lower(k), 'api_key|apikey|authorization|token|secret|password|bearer') THEN '***redacted***' ELSE v END AS value FROM k
""")
def q29_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pick(KEYS, F.col("event_id") % len(KEYS))
    logged = table(spark, sf_dir, "events").select("event_id", provider.scrub(F.create_map(key, "event_type")).alias("fields"))
    return logged.select("event_id", F.explode("fields").alias("key", "value"))


@query("""
    SELECT b.item_id, count(d.doc_id) AS hits, coalesce(min(d.doc_id), -1) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1
""")
def q30_expected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expected_facts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def expected_facts(docs: DataFrame, facts: DataFrame, block: int = 20_000) -> DataFrame:
    """For each stated fact: documents that hold it, and the first of them.

    A fact can begin inside a word, so no equality finds it. The facts are a
    stated query set and go out in blocks of bounded size; a block is one
    automaton, which reads each text once for all of its facts. A task sums up
    what it found before anything is shuffled.
    """
    import ahocorasick

    facts = facts.select("item_id", "text").where("text IS NOT NULL")
    pieces = max(1, -(-facts.count() // block))
    numbered = facts.withColumn("__piece", F.pmod(F.xxhash64("item_id"), F.lit(pieces)))
    found = None
    for k in range(pieces):
        by_text: dict[str, list[int]] = {}
        for r in numbered.where(F.col("__piece") == k).toLocalIterator():
            by_text.setdefault(r.text, []).append(r.item_id)
        shared = facts.sparkSession.sparkContext.broadcast(by_text)

        def run(batches, shared=shared):
            machine = ahocorasick.Automaton()
            for t in shared.value:
                if t:
                    machine.add_word(t, t)
            machine.make_automaton()
            always = {""} & shared.value.keys()
            counts: dict[str, list[int]] = {}
            for b in batches:
                for doc, body in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for t in always.union(t for _, t in machine.iter(body)) if len(machine) else always:
                        held = counts.setdefault(t, [0, None])
                        held[0] += 1
                        if doc is not None:
                            held[1] = doc if held[1] is None else min(held[1], doc)
            rows = [(i, n, first) for t, (n, first) in counts.items() for i in shared.value[t]]
            yield pa.record_batch([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item_id", "hits", "first_doc"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(run, "item_id long, hits long, first_doc long")
        found = part if found is None else found.unionByName(part)
    total = found.groupBy("item_id").agg(F.sum("hits").alias("hits"), F.min("first_doc").alias("first_doc"))
    return facts.select("item_id").join(total, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), F.coalesce("first_doc", F.lit(-1).cast("long")).alias("first_doc"))


@query(f"""
    WITH p AS (SELECT doc_id, {SQL_STRIP.format("text")} AS t FROM documents),
    w AS (SELECT doc_id, length(t) < 120 OR (CASE WHEN length(t) = 0 THEN 0 ELSE {SQL_PRINTABLE.format("t")} / length(t) END) < 0.6 AS weak FROM p)
    SELECT weak, quality, count(*) AS n FROM w JOIN labels USING (doc_id) GROUP BY 1, 2
""")
def q31_quality_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "documents").select("doc_id", text.strip(F.col("text")).alias("t"))
    weak = clean.select("doc_id", text.needs_fallback(F.length("t"), text.printable_ratio(F.col("t"))).alias("weak"))
    return weak.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("weak", "quality").agg(F.count(F.lit(1)).alias("n"))


def sql_prompt() -> str:
    nl = "' || chr(10) || '"
    out = ["'Task type: ' || replace(p, '_', ' ')", "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in provider.TASKS.items()) + " END"]
    out.append(f"'Answer this question, and show what in the image proves the answer:{nl}{nl}<question>{nl}' || q || '{nl}</question>'")
    out.append("'Detail level: normal. " + provider.DETAILS["normal"] + "'")
    out.append("'Use these headings in this order, without those that would be empty:" + "".join(f"{nl}## {s}" for s in provider.SECTIONS) + "'")
    return " || chr(10) || chr(10) || ".join(out)


@query(f"WITH t AS (SELECT conv_id, turn, {SQL_PROFILE} AS p, {SQL_STRIP.format('text')} AS q FROM {SQL_ASKED}) SELECT conv_id, turn, p AS profile, sha256({sql_prompt()}) AS prompt FROM t")
def q32_prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = asked(spark, sf_dir).withColumn("profile", profile(F.col("text")))
    return turns.select("conv_id", "turn", "profile", F.sha2(provider.prompt(F.col("profile"), F.col("text"), F.lit("normal")), 256).alias("prompt"))


PATHS = ["/data/ws/a.txt", "/data/ws-evil/a.txt", "/data/ws/../etc/passwd", "/data/ws/./b//c.txt", "rel/x.md", "../x", "", "  ", "data:text/plain,x", "DATA:x", "http://h/x", "file:///data/ws/a", "\\\\srv\\share", "C:\\x\\y.txt", "/other/a", "/data/ws", "/srv/pub/q.pdf", " /data/ws/pad.txt "]
ROOTS = ("/data/ws", "/srv/pub")


def sql_path_code(p: str) -> str:
    """The code of a path with at most one '..', by its syntax and its place below the roots."""
    place = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, '(/\\.)+/', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\\.\\.(/|$)', '/')"
    inside = lambda c: "(" + " OR ".join(f"{place(c)} = '{r}' OR starts_with({place(c)}, '{r}/')" for r in ROOTS) + ")"
    below = " OR ".join(inside(f"'{r}/' || trim({p})") for r in ROOTS)
    return rf"""CASE WHEN trim({p}) = '' OR regexp_matches({p}, '(?i)^data:') OR regexp_matches({p}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'INVALID_ARGUMENT'
        WHEN regexp_matches({p}, '^\\\\[^\\]') OR regexp_matches({p}, '^[A-Za-z]:[\\/]') THEN 'PATH_NOT_ALLOWED'
        WHEN starts_with(trim({p}), '/') THEN CASE WHEN NOT {inside(f"trim({p})")} THEN 'PATH_NOT_ALLOWED' END
        WHEN NOT ({below}) THEN 'PATH_NOT_ALLOWED' END"""


SQL_PATHS = f"(SELECT event_id, ({sql_list(PATHS)})[event_id % {len(PATHS)} + 1] AS p FROM events)"


@query(f"SELECT coalesce({sql_path_code('p')}, 'ok') AS code, count(*) AS n FROM {SQL_PATHS} GROUP BY 1")
def q33_sandbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = F.array(F.lit(ROOTS[0]), F.lit(ROOTS[1] + "/"))
    paths = table(spark, sf_dir, "events").select(pick(PATHS, F.col("event_id") % len(PATHS)).alias("path"))
    return paths.groupBy(F.coalesce(sandbox.textual_code(F.col("path"), roots), F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
    WITH p AS (SELECT doc_id, text, greatest(1, ceil(length(text) / 500))::INT AS n FROM documents),
    s AS (SELECT doc_id, n, list_transform(range(1, n + 1), lambda k: substr(text, ((k - 1) * 500 + 1)::BIGINT, 500)) AS ps FROM p),
    w AS (SELECT doc_id, n, list_transform(ps, lambda x: regexp_replace(x, '[\s\x1c-\x1f\x{85}\x{a0}]+$', '')) AS ps, len(list_filter(ps, lambda x: length(regexp_replace(x, '^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$', '', 'g')) < 120)) AS weak FROM s)
    SELECT doc_id, n::BIGINT AS pages, weak::BIGINT AS weak_pages, sha256(array_to_string(list_transform(ps, lambda x, i: '### Page ' || i || chr(10) || chr(10) || CASE WHEN x <> '' THEN x ELSE '_(blank page)_' END), chr(10) || chr(10))) AS content FROM w
""")
def q34_pdf_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in pieces of 500 characters as pages, put together in the row, so that nothing is gathered."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 500)).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col("text"), (k - 1) * 500 + 1, F.lit(500)))
    paged = table(spark, sf_dir, "documents").select("doc_id", pieces.alias("pieces"))

    def section(piece: "F.Column", at: "F.Column") -> "F.Column":
        whole = text.rstrip(piece)
        return F.concat(F.lit("### Page "), (at + 1).cast("string"), F.lit("\n\n"), F.when(whole != "", whole).otherwise("_(blank page)_"))

    weak = F.size(F.filter("pieces", lambda x: F.length(text.strip(x)) < 120))
    content = F.array_join(F.transform("pieces", section), "\n\n")
    return paged.select("doc_id", F.size("pieces").cast("long").alias("pages"), weak.cast("long").alias("weak_pages"), F.sha2(content, 256).alias("content"))


@query("SELECT date_trunc('hour', ts)::VARCHAR AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q35_stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, run over what is there."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(*_stream_source(sf_dir))
    name = f"windows_{uuid.uuid4().hex}"
    counted = run_to_table(window_counts(stream), name, f"{shared_folder(spark)}/{name}")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


def _stream_source(sf_dir: str) -> tuple[str]:
    return (f"{sf_dir}/events.parquet*",)


@query("""
    WITH m AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, max(n) AS busiest, count(*) AS hours FROM m GROUP BY 1
""")
def q36_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("user_id").agg(F.max("n").alias("busiest"), F.count(F.lit(1)).alias("hours"))


@query("""
    SELECT event_id, sha256('{"model":"m","messages":[{"role":"user","content":[{"type":"text","text":"' || event_type || '"}' || CASE WHEN event_id % 2 = 0 THEN ',{"type":"text","text":"[Image 1 of 1: whole image, scaled down from 9000x800]"}' ELSE '' END
        || ',{"type":"image_url","image_url":{"url":"data:image/png;base64,' || to_base64(encode(event_id::VARCHAR)) || '"}}]}],"max_tokens":1400,"temperature":0}') AS payload FROM events
""")
def q37_provider_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.struct(
        F.lit("image/png").alias("mime"), F.col("event_id").cast("string").cast("binary").alias("content"), F.lit("").alias("label"), F.when(F.col("event_id") % 2 == 0, "overview").alias("role"),
        *[F.lit(None).cast("int").alias(k) for k in ("x", "y", "w", "h")], F.lit(9000).alias("original_w"), F.lit(800).alias("original_h"),
    )
    made = provider.payload(F.lit("m"), F.col("event_type"), F.lit(None).cast("string"), F.array(image), 1400)
    return table(spark, sf_dir, "events").select("event_id", F.sha2(made, 256).alias("payload"))


# -- requests through the engine ---------------------------------------------


@query(f"SELECT coalesce({sql_path_code('p')}, CASE WHEN p = '/data/ws/a.txt' THEN 'ok' ELSE 'FILE_NOT_FOUND' END) AS code, count(*) AS n FROM {SQL_PATHS} GROUP BY 1")
def q38_request_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for paths of all kinds, through the whole engine, which may read below two roots; one of the files is there."""
    paths = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("request_id"), pick(PATHS, F.col("event_id") % len(PATHS)).alias("path"))
    there = spark.createDataFrame([("a", "a fact\n")], "name string, text string")
    files = text_files(there, id_col="name", text_col="text").withColumn("path", F.concat(F.lit("/data/ws/"), "name"))
    out = Engine(spark, Settings(allowed_roots=ROOTS)).analyze(requests_for(paths), files)
    return out.groupBy(F.coalesce("error.code", F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH d AS (SELECT doc_id, text, greatest(1, ceil(length(text) / 700))::INT AS total FROM documents),
    s AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE least(total, 30) END AS sel FROM d),
    p AS (SELECT doc_id, total, sel, unnest(list_transform(range(1, sel + 1), lambda k: substr(text, ((k - 1) * 700 + 1)::BIGINT, 700))) AS page FROM s),
    t AS (SELECT doc_id, total, sel, {SQL_STRIP.format("page")} AS t FROM p),
    w AS (SELECT doc_id, total, sel, count(*) FILTER (length(t) < 120 OR (CASE WHEN length(t) = 0 THEN 0 ELSE {SQL_PRINTABLE.format("t")} / length(t) END) < 0.6) AS thin FROM t GROUP BY ALL)
    SELECT doc_id, 'PDF `' || doc_id || '.pdf`: ' || total || ' page(s), ' || sel || ' selected' || CASE WHEN sel > thin THEN '; ' || (sel - thin) || ' read from the embedded text layer' ELSE '' END
        || CASE WHEN thin > 0 THEN '; ' || thin || ' below the text-density threshold (120 chars/page) handled by fallback' ELSE '' END || '.' AS summary,
        sel::BIGINT AS n_evidence, ((thin > 0)::INT + (doc_id % 2 = 0 AND total > 30)::INT)::BIGINT AS n_warnings FROM w
""")
def q39_pdf_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files of 700 characters a page, every second one asked for its first page alone."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 700)).cast("int")
    pages = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col("text"), (k - 1) * 700 + 1, F.lit(700))), "\f")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("%PDF-1.7\n"), pages).alias("body"))
    files = text_files(docs, id_col="doc_id", text_col="body", extension=".pdf")
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    out = Engine(spark, pdf=FakePdf()).analyze(requests_for(files.select("path"), pages=F.when(number % 2 == 1, "1")), files)
    return out.select(F.regexp_extract("request_id", "([0-9]+)", 1).cast("long").alias("doc_id"), "summary", F.size("evidence").cast("long").alias("n_evidence"), F.size("warnings").cast("long").alias("n_warnings"))


def event_images(spark: SparkSession, sf_dir: str, width: "F.Column", height: "F.Column") -> DataFrame:
    """Events as PNG files of a header each, with the event's number after it; without a size the header ends after its mark."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    header = F.coalesce(F.concat(F.unhex(F.lit("0000000D49484452")), number(width), number(height)), F.lit(b""))
    content = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), header, F.col("event_id").cast("string").cast("binary"))
    files = table(spark, sf_dir, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".png")).alias("path"), content.alias("content"))
    return files.withColumns({"name": F.col("path"), "extension": F.lit(".png"), "size_bytes": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "modified_at": F.lit(None).cast("timestamp")})


@query("""
    WITH r AS (SELECT event_id, (['auto', 'ocr', 'vision', 'document'])[event_id % 4 + 1] AS mode, event_id % 3 = 0 AS visual FROM events)
    SELECT mode, CASE mode WHEN 'vision' THEN 'VISION_NOT_CONFIGURED' WHEN 'document' THEN 'MODE_NOT_APPLICABLE' ELSE 'ok' END AS code,
        (CASE WHEN mode IN ('auto', 'ocr') THEN 1 ELSE 0 END)::BIGINT AS n_evidence, (CASE WHEN mode IN ('auto', 'ocr') THEN 1 + visual::INT ELSE 0 END + (mode = 'auto' AND visual)::INT)::BIGINT AS n_warnings, count(*) AS n FROM r GROUP BY ALL
""")
def q40_image_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images in every mode, with an OCR engine and without a vision provider; a third of the questions need eyes.

    A transcription says that it is one, that it answers no question, and that a question needed eyes.
    """
    files = event_images(spark, sf_dir, F.lit(None).cast("long"), F.lit(None).cast("long"))
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    asked = requests_for(files.select("path"), mode=pick(["auto", "ocr", "vision", "document"], number % 4), question=F.when(number % 3 == 0, "Why is the button disabled?"))
    out = Engine(spark, ocr=FakeOcr()).analyze(asked, files)
    return out.groupBy("request.mode", F.coalesce("error.code", F.lit("ok")).alias("code"), F.size("evidence").cast("long").alias("n_evidence"), F.size("warnings").cast("long").alias("n_warnings")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws, doc_id % 5 + 1 AS k FROM documents),
    n AS (SELECT *, greatest(1, ceil(len(ws) / k))::INT AS per, CASE doc_id % 3 WHEN 0 THEN k WHEN 1 THEN 1 ELSE least(k, 2) END AS upto FROM w),
    s AS (SELECT doc_id, upto, list_transform(range(1, upto + 1), lambda i: {SQL_STRIP.format("array_to_string(ws[((i - 1) * per + 1)::INT:(i * per)::INT], ' ')")}) AS bodies FROM n)
    SELECT doc_id, upto::BIGINT AS n_evidence, sha256(array_to_string(list_transform(bodies, lambda x, i: '### Slide ' || i || chr(10) || chr(10) || CASE WHEN x <> '' THEN x ELSE '_(no text)_' END), chr(10) || chr(10))) AS content FROM s
""")
def q41_slide_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of one to five slides: all of them, the first, or up to two, as a request chooses."""
    k, words, per = (F.col("doc_id") % 5 + 1).cast("int"), F.col("words"), F.col("per")
    cut = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda x: x != "").alias("words"))
    cut = cut.withColumn("per", F.greatest(F.lit(1), F.ceil(F.size("words") / k)).cast("int"))
    body = lambda i: F.array_join(F.slice(words, (i - 1) * per + 1, per), " ")
    md = F.array_join(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("<!-- Slide number: "), i.cast("string"), F.lit(" -->\n"), body(i))), "\n\n")
    pages = F.when(F.col("doc_id") % 3 == 1, "1").when((F.col("doc_id") % 3 == 2) & (k > 1), "1-2").when(F.col("doc_id") % 3 == 2, "1")
    found = cut.select("doc_id", sections.split_slides(md, k).alias("s"), pages.alias("e")).withColumn("p", text.page_selection(F.col("e"), F.size("s"), 30)["pages"])
    kept = F.filter("s", lambda x: F.array_contains(F.col("p"), x["name"].cast("int")))
    return found.select("doc_id", F.size(sections.section_evidence(kept, "slide", "slide ")).cast("long").alias("n_evidence"), F.sha2(sections.rebuild_slides(F.col("s"), F.col("p")), 256).alias("content"))


@query("""
    WITH e AS (SELECT sha256(user_id::VARCHAR) AS cache_key, sum(round(value * 100)::BIGINT)::BIGINT AS size_bytes, min(ts) AS stored, max(ts) FILTER (event_type = 'view') AS used FROM events GROUP BY user_id),
    n AS (SELECT max(ts) AS now FROM events),
    f AS (SELECT cache_key, size_bytes, greatest(stored, coalesce(used, stored)) AS last_access FROM e, n WHERE epoch(now)::BIGINT - epoch(stored)::BIGINT <= 29 * 86400),
    w AS (SELECT *, sum(size_bytes) OVER () - coalesce(sum(size_bytes) OVER (ORDER BY last_access, size_bytes, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1000000 AS evicted FROM f)
    SELECT cache_key, size_bytes FROM w WHERE NOT evicted
""")
def q42_cache_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entries, stored at their first event and used at each view: what is left of the table after an upkeep."""
    import uuid

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = events.agg(F.max("ts")).first()[0]
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    key = F.sha2(F.col("user_id").cast("string"), 256)
    stored = events.groupBy(key.alias("cache_key")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("size_bytes"), F.min("ts").alias("stored_at"))
    cache.put(stored.select("cache_key", F.lit(2).alias("schema_version"), "stored_at", F.col("stored_at").alias("last_access"), "size_bytes", F.lit("{}").alias("payload")), path)
    used = events.where("event_type = 'view'").select(key.alias("cache_key"), "ts").groupBy("cache_key").agg(F.max("ts").alias("last_access"))
    used.write.mode("append").parquet(path + ".used")
    cache.upkeep(spark, path, F.lit(now), 29, 1_000_000)
    return spark.read.parquet(path).select("cache_key", "size_bytes")


CLOUD = {"vision_base_url": "https://v.example/v1", "vision_api_key": "k", "vision_model": "m", "allow_cloud_vision": True}
SQL_SCALED = "greatest(1, round_even({0} * least(1.0, 4096.0::DOUBLE / l), 0))::BIGINT"
SQL_TILE = "CASE WHEN h >= w THEN '0,' || (k * 4000) || ',' || w || ',' || (least(k * 4000 + 4096, l) - k * 4000) || ' ' || w || 'x' || (least(k * 4000 + 4096, l) - k * 4000) ELSE (k * 4000) || ',0,' || (least(k * 4000 + 4096, l) - k * 4000) || ',' || h || ' ' || (least(k * 4000 + 4096, l) - k * 4000) || 'x' || h END"


@query(f"""
    WITH s AS (SELECT event_id, (event_id * 37) % 9000 + 10 AS w, (event_id * 91) % 15000 + 10 AS h, event_id % 2 = 0 AS ui FROM events),
    g AS (SELECT *, greatest(w, h) AS l, least(w, h) AS m, greatest(1, ceil((greatest(w, h) - 96) / 4000.0))::INT AS n FROM s),
    p AS (SELECT *, CASE WHEN w * h > 40000000 THEN 'gate' WHEN l <= 4096 THEN 'as_is' WHEN l / m >= 2.5 AND m <= 4096 AND n <= 4 THEN 'tiles' ELSE 'downscale' END AS plan, {SQL_SCALED.format("w")} || 'x' || {SQL_SCALED.format("h")} AS small FROM g)
    SELECT event_id, CASE WHEN plan = 'gate' THEN 'FILE_TOO_LARGE' ELSE 'ok' END AS code, (plan IN ('tiles', 'downscale'))::BIGINT AS n_warnings,
        CASE plan WHEN 'gate' THEN '' WHEN 'tiles' THEN CASE WHEN ui THEN 'png 0,0,' || w || ',' || h || ' ' || small || '; ' ELSE '' END || array_to_string(list_transform(range(0, n), lambda k: 'png ' || {SQL_TILE}), '; ') ELSE 'png  ' || small END AS shown FROM p
""")
def q43_image_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of all sizes through the engine to a vision backend that says what it was shown; every second one is read as a screen."""
    files = event_images(spark, sf_dir, (F.col("event_id") * 37) % 9000 + 10, (F.col("event_id") * 91) % 15000 + 10)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    asked = requests_for(files.select("path"), mode="vision", vision_profile=F.when(number % 2 == 0, "ui_structure").otherwise("general"))
    out = Engine(spark, Settings(**CLOUD), vision=TellingVision(), codec=FakeCodec()).analyze(asked, files)
    return out.select(F.regexp_extract("request_id", "([0-9]+)", 1).cast("long").alias("event_id"), F.coalesce("error.code", F.lit("ok")).alias("code"), F.size("warnings").cast("long").alias("n_warnings"), F.col("summary").alias("shown"))


#: What a provider answers, by the number of an event: a status, or none (0: too late, -1: no connection).
ANSWERS = [200, 200, 200, 200, 200, 401, 402, 403, 404, 408, 429, 500, 503, 0, -1]
SEEN = "## ANSWER\nseen {}\n\n## INFERENCE\n- a guess\n- another"


def answer(body: str) -> Reply:
    """The reply that a question asks for by its numbers."""
    import json
    import re

    kind, number = map(int, re.search(r"reply ([0-9]+) for ([0-9]+)", body).groups())
    status = ANSWERS[kind]
    if status < 1:
        return Reply(None, failure="network" if status else "timeout")
    if status != 200:
        return Reply(status, "slow down" if number % 2 else "Quota used up")
    said = SEEN.format(number)
    content = [said, [{"type": "text", "text": said}], " ", said, None][kind]
    return Reply(200, json.dumps({"model": "served", "choices": [{"finish_reason": "length" if kind == 3 else "stop"} | ({} if kind == 4 else {"message": {"content": content}})]}))


def at_once(seconds: float) -> None:
    """Waits for nothing."""


def sql_text(value: str) -> str:
    """A SQL expression for a text with lines."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_errors() -> str:
    cases = " ".join(f"WHEN '{c}' THEN " + sql_text(f"## Error: {c}\n\n{m}\n\n**What to do:** {h}") for c, (m, h) in errors.ERRORS.items())
    return f"CASE code {cases} END"


def sql_seen() -> str:
    """The Markdown of an answered request of q44, with the event's number for %."""
    ocr = FakeOcr().text
    unsent, short = "- The OCR text was not sent to the provider (send_ocr_to_cloud is off); it is given below.", "- The model stopped at its limit of output tokens (vision_max_output_tokens); the reading is not complete."
    whole = f"## Summary\n\nseen %\n\n## Answer to the requested question\n\nseen %\n\n## Extracted content\n\n### Answer\n\nseen %\n\n### Inference (beyond what is literally visible)\n\n- a guess\n- another\n\n### {provider.UNSENT}\n\n```text\n{ocr}\n```\n\n## Evidence\n\n- **ocr** (%.png) [confidence 91%%]: {ocr}\n- **inference**: a guess\n- **inference**: another\n\n## Warnings\n\n{unsent}"
    return f"replace(replace(replace({sql_text(whole)}, '%%', '@@'), '%', event_id::VARCHAR), '@@', '%') || CASE WHEN k = 3 THEN {sql_text(chr(10) + short)} ELSE '' END"


@query(f"""
    WITH e AS (SELECT event_id, event_id % {len(ANSWERS)} AS k, ([{", ".join(map(str, ANSWERS))}])[event_id % {len(ANSWERS)} + 1] AS s FROM events),
    c AS (SELECT *, CASE WHEN k = 2 THEN 'VISION_EMPTY_RESPONSE' WHEN k = 4 THEN 'VISION_INVALID_RESPONSE' WHEN s = 200 THEN 'ok' WHEN s = 429 AND event_id % 2 = 0 THEN 'VISION_QUOTA_EXCEEDED'
        {" ".join(f"WHEN s = {k} THEN '{c}'" for k, (c, _) in provider.STATUS.items())} WHEN s = 0 THEN 'VISION_PROVIDER_TIMEOUT' ELSE 'VISION_PROVIDER_ERROR' END AS code FROM e)
    SELECT event_id, code, CASE WHEN code = 'ok' THEN 'served' END AS model, sha256(CASE WHEN code = 'ok' THEN {sql_seen()} ELSE {sql_errors()} END) AS markdown FROM c
""")
def q44_provider_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images through the engine to a provider that answers in every way: readings, empty and odd replies, refusals and silence."""
    files = event_images(spark, sf_dir, F.lit(640), F.lit(480))
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    question = F.concat(F.lit("Why reply "), (number % len(ANSWERS)).cast("string"), F.lit(" for "), number.cast("string"), F.lit("?"))
    vision = HttpVision(FakeTransport(answer), "m", wait=at_once)
    out = Engine(spark, Settings(**CLOUD, send_ocr_to_cloud=False), ocr=FakeOcr(), vision=vision).analyze(requests_for(files.select("path"), question=question), files)
    return out.select(F.regexp_extract("request_id", "([0-9]+)", 1).cast("long").alias("event_id"), F.coalesce("error.code", F.lit("ok")).alias("code"), F.when(F.col("success"), F.col("processing.model")).alias("model"), F.sha2("markdown", 256).alias("markdown"))


MODES, DETAIL, ASKED_PROFILES = ["auto", "document", "ocr", "vision", "AUTO", None], ["compact", "normal", "full", "brief"], ["auto", "ui_structure", "ui_screenshot", "terminal", "table", None, "general"]
PLANS, INTENTS = ["auto", "ocr", "vision", "hybrid", "ocr_only"], ["visual_semantics", "text_extraction", "unknown"]


def sql_pick(values, index: str) -> str:
    return f"({sql_list(values)})[({index}) % {len(values)} + 1]"


@query(f"""
    WITH e AS (SELECT event_id, {sql_pick(MODES, "event_id")} AS mode, {sql_pick(DETAIL, "event_id // 6")} AS detail, {sql_pick(ASKED_PROFILES, "event_id // 24")} AS prof, {sql_pick(PLANS, "event_id")} AS plan, {sql_pick(INTENTS, "event_id // 5")} AS intent,
        event_id % 2 = 0 AS ran, event_id % 7 < 3 AS usable, event_id % 11 < 6 AS good, (event_id % 9 - 3) * 20000 AS chars FROM events)
    SELECT event_id, CASE WHEN mode IN ('auto', 'document', 'ocr', 'vision') AND detail <> 'brief' AND prof IN ('auto', 'ui_structure', 'terminal', 'general') THEN 'ok' ELSE 'INVALID_ARGUMENT' END AS code,
        CASE WHEN plan = 'vision' OR (plan <> 'ocr' AND usable AND (NOT ran OR intent = 'visual_semantics')) THEN 'vision' WHEN ran THEN 'ocr' ELSE 'neither' END AS page_backend,
        CASE WHEN plan = 'ocr_only' THEN CASE WHEN ran THEN 'ocr' ELSE 'error' END WHEN plan <> 'vision' AND ran AND intent = 'text_extraction' AND good THEN 'ocr_local' WHEN usable THEN 'vision' WHEN ran THEN 'ocr_degraded' ELSE 'error' END AS image_way,
        least(CASE WHEN chars > 0 THEN chars ELSE 50000 END, 50000)::BIGINT AS budget FROM e
""")
def q45_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments, budgets, and the way of weak pages and images, for every combination that the events' numbers make."""
    i = F.col("event_id")
    of = lambda values, index: pick(values, index % len(values))
    plan, what, ran, usable = of(PLANS, i), of(INTENTS, F.floor(i / 5)), i % 2 == 0, i % 7 < 3
    code = route.argument_error(of(MODES, i), of(DETAIL, F.floor(i / 6)), of(ASKED_PROFILES, F.floor(i / 24)))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(code, F.lit("ok")).alias("code"), route.weak_page_backend(plan, ran, usable, what).alias("page_backend"), route.resolution(plan, ran, usable, what, i % 11 < 6).alias("image_way"), route.budget((i % 9 - 3) * 20000, 50_000).cast("long").alias("budget"))


@query(rf"""
    WITH t AS (SELECT doc_id, {SQL_STRIP.format("text")} AS t FROM documents)
    SELECT doc_id, sha256(CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(left(t, 400), '[\s\x1c-\x1f\x{{85}}\x{{a0}}]+$', '') || ' ...' END) AS excerpt FROM t
""")
def q46_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.excerpt(F.col("text")), 256).alias("excerpt"))


AFTER = ["3", "0", " 4", "x", None, "12.5", "٣", "9999999999"]


@query(f"""
    WITH e AS (SELECT event_id, {sql_pick(AFTER, "event_id")} AS a, event_id % 6 AS k, event_id % 4 AS kind FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(a, '[0-9]{{1,9}}') THEN a::INT END AS retry_after, least(4.0, 0.5 * 2 ** k)::DOUBLE / 2 AS least, least(4.0, 0.5 * 2 ** k)::DOUBLE AS most,
        CASE kind WHEN 0 THEN 'routed' WHEN 1 THEN 'print' END AS route, CASE WHEN kind < 3 THEN event_id END AS input_tokens, CASE WHEN kind < 2 THEN event_id % 100 END AS output_tokens FROM e
""")
def q47_provider_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider says of waiting and of tokens, and the bounds of the wait before an attempt."""
    i, kind = F.col("event_id"), F.col("event_id") % 4
    usage = F.when(kind < 2, F.struct(i.alias("prompt_tokens"), (i % 100).alias("completion_tokens"))).when(kind == 2, F.struct(i.alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens")))
    body = F.to_json(F.struct(F.lit("z").alias("model"), F.when(kind == 0, "routed").alias("provider"), F.when(kind <= 1, "print").alias("system_fingerprint"), usage.alias("usage")))
    wait, report = provider.retry_bounds(i % 6), provider.completion_report(body)
    return table(spark, sf_dir, "events").select("event_id", provider.retry_after(pick(AFTER, i % len(AFTER))).alias("retry_after"), wait["least"].alias("least"), wait["most"].alias("most"), report["route"].alias("route"), report["input_tokens"].alias("input_tokens"), report["output_tokens"].alias("output_tokens"))


@query(r"""
    WITH d AS (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS plain FROM documents)
    SELECT doc_id, (['utf-8-sig', 'cp1252', 'latin-1'])[doc_id % 3 + 1] AS encoding, doc_id % 3 > 0 AS warned, sha256(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'café “' || plain ELSE chr(129) || ' é' || plain END) AS text FROM d
""")
def q48_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files with a mark of UTF-8, in Windows' Western encoding, and with a byte that this has not."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?").cast("binary")
    kind = F.col("doc_id") % 3
    content = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))).when(kind == 1, F.concat(F.unhex(F.lit("636166E92093")), plain)).otherwise(F.concat(F.unhex(F.lit("8120E9")), plain))
    read = decode_texts(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")))
    return read.select("doc_id", "encoding", F.col("decode_warning").isNotNull().alias("warned"), F.sha2("text", 256).alias("text"))


@query("SELECT count(*) AS requests, 0::BIGINT AS first_hits, count(*) AS second_hits, count(DISTINCT coalesce(text, '')) AS entries FROM documents")
def q49_shared_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents asked about twice: equal texts are one entry of the cache, and the second time all is there."""
    import uuid

    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    files = text_files(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    hits = F.count_if("processing.cached")
    first = Engine(spark, cache_path=path).analyze(requests_for(files.select("path")), files).agg(F.count(F.lit(1)).alias("requests"), hits.alias("first_hits"))
    second = Engine(spark, cache_path=path).analyze(requests_for(files.select("path")), files).agg(hits.alias("second_hits"))
    return first.select("requests", "first_hits", second.scalar().alias("second_hits"), spark.read.parquet(path).agg(F.count(F.lit(1))).scalar().alias("entries"))


SLIDE_XML, RELATION = '<s xmlns:a="a">{}</s>', '<x Id="r{0}" Target="{1}{0}.xml"/>'


def _packed(members: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def _deck(doc: int) -> bytes:
    n = range(1, doc % 5 + 2)
    members = {"ppt/presentation.xml": '<p xmlns:r="r">' + "".join(f'<sldId r:id="r{k}"/>' for k in n) + "</p>", "ppt/_rels/presentation.xml.rels": "<R>" + "".join(RELATION.format(k, "slides/s") for k in n) + "</R>"}
    members |= {f"ppt/slides/s{k}.xml": SLIDE_XML.format(f"<a:p><a:t>Topic {k}</a:t></a:p><a:p><a:t>of {doc}</a:t></a:p>") for k in n}
    return _packed(members)


def _workbook(doc: int) -> bytes:
    n = range(1, doc % 3 + 2)
    members = {"xl/workbook.xml": '<w xmlns:r="r">' + "".join(f'<sheet name="S{k}" r:id="r{k}"/>' for k in n) + "</w>", "xl/_rels/workbook.xml.rels": "<R>" + "".join(RELATION.format(k, "s") for k in n) + "</R>"}
    cell = '<c r="{}1" t="inlineStr"><is><t>{}</t></is></c>'
    members |= {f"xl/s{k}.xml": f'<s><row>{cell.format("A", "key")}{cell.format("B", "no")}</row><row><c r="A2"><v>{doc}</v></c><c r="B2"><v>{k}</v></c></row></s>' for k in n}
    return _packed(members)


@query(r"""
    WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS deck, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 + 1 ELSE doc_id % 3 + 1 END AS n, doc_id % 4 < 2 AS paged FROM documents),
    m AS (SELECT *, CASE WHEN deck THEN list_transform(range(1, n + 1), lambda k: '<!-- Slide number: ' || k || ' -->' || chr(10) || 'Topic ' || k || chr(10) || 'of ' || doc_id)
        ELSE list_transform(range(1, n + 1), lambda k: '## S' || k || chr(10) || chr(10) || '| key | no |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || k || ' |') END AS parts, CASE WHEN deck AND paged THEN 1 ELSE n END AS shown FROM d),
    s AS (SELECT *, array_to_string(parts, chr(10) || chr(10)) AS md, CASE WHEN deck THEN 'PPTX document `' || doc_id || '.pptx`' ELSE 'XLSX document `' || doc_id || '.xlsx`' END || ' converted to Markdown. '
        || CASE WHEN deck THEN n || ' slide(s)' ELSE 'sheets: ' || array_to_string(list_transform(range(1, n + 1), lambda k: 'S' || k), ', ') END AS head FROM m)
    SELECT doc_id, head || '. ' || length(md) || ' characters of Markdown.' AS summary, shown::BIGINT AS n_evidence, (NOT deck AND paged)::BIGINT AS n_warnings,
        sha256('## Summary' || chr(10) || chr(10) || head || '. ' || length(md) || ' characters of Markdown.' || chr(10) || chr(10) || '## Extracted content' || chr(10) || chr(10)
            || CASE WHEN deck THEN array_to_string(list_transform(range(1, shown + 1), lambda k: '### Slide ' || k || chr(10) || chr(10) || 'Topic ' || k || chr(10) || 'of ' || doc_id), chr(10) || chr(10)) ELSE md END
            || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || array_to_string(list_transform(range(1, shown + 1), lambda k: CASE WHEN deck THEN '- **slide** (slide ' || k || '):' || chr(10) || chr(10) || '  Topic ' || k || chr(10) || 'of ' || doc_id
                ELSE '- **sheet** (S' || k || '):' || chr(10) || chr(10) || '  | key | no |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || k || ' |' END), chr(10))
            || CASE WHEN NOT deck AND paged THEN chr(10) || chr(10) || '## Warnings' || chr(10) || chr(10) || '- The ''pages'' parameter does not apply to spreadsheets; all sheets were converted.' ELSE '' END) AS markdown FROM s
""")
def q50_decks_and_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck or a workbook for each document, through the whole engine; half of them with a page list."""
    from collections.abc import Iterator

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            yield pa.record_batch([pa.array([f"{i}.{'xlsx' if i % 2 else 'pptx'}" for i in ids]), pa.array([(_workbook if i % 2 else _deck)(i) for i in ids], pa.binary())], ["path", "content"])

    made = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(build, "path string, content binary")
    # Archives carry the time at which they are made, so the digest is of the name: equal names are equal files here.
    files = made.withColumns({"name": F.col("path"), "extension": F.regexp_extract("path", r"(\.[a-z]+)$", 1), "size_bytes": F.octet_length("content").cast("long"), "sha256": F.sha2("path", 256), "modified_at": F.lit(None).cast("timestamp")})
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    out = Engine(spark).analyze(requests_for(files.select("path"), pages=F.when(number % 4 < 2, "1")), files)
    return out.select(F.regexp_extract("request_id", "([0-9]+)", 1).cast("long").alias("doc_id"), "summary", F.size("evidence").cast("long").alias("n_evidence"), F.size("warnings").cast("long").alias("n_warnings"), F.sha2("markdown", 256).alias("markdown"))


SQL_LOUD = "translate(left(text, 10), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"""
    WITH c AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 11 > 0 AS success, doc_id % 7 = 0 AS eyes, CASE doc_id % 3 WHEN 0 THEN [{SQL_LOUD}] WHEN 1 THEN [{SQL_LOUD}, 'not in a text: ' || doc_id] ELSE [] END AS facts FROM documents),
    m AS (SELECT *, list_filter(facts, lambda f: NOT contains(lower(text), lower(f))) AS missed FROM c)
    SELECT doc_id::VARCHAR AS request_id, CASE WHEN eyes THEN 'SKIP' WHEN success AND len(missed) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, len(missed)::BIGINT AS n_missed FROM m
""")
def q51_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases about every document, with facts that it holds in capitals or does not hold, and needs that are met or not."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), "doc_id", F.coalesce("text", F.lit("")).alias("markdown"))
    loud = F.translate(F.substring("markdown", 1, 10), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    absent = F.concat(F.lit("not in a text: "), "request_id")
    facts = F.when(F.col("doc_id") % 3 == 0, F.array(loud)).when(F.col("doc_id") % 3 == 1, F.array(loud, absent)).otherwise(F.array().cast("array<string>"))
    cases = docs.select("request_id", facts.alias("must_contain"), (F.col("doc_id") % 5 == 0).alias("needs_ocr"), (F.col("doc_id") % 7 == 0).alias("needs_vision"))
    found = verdicts(cases, docs.withColumn("success", F.col("doc_id") % 11 > 0), ocr=True, vision=False)
    return found.select("request_id", "verdict", F.size("missed").cast("long").alias("n_missed"))


@query("""
    WITH e AS (SELECT sha256(user_id::VARCHAR) AS cache_key, sum(round(value * 100)::BIGINT)::BIGINT AS size_bytes, min(ts) AS stored, max(ts) AS last_access FROM events GROUP BY user_id),
    n AS (SELECT max(ts) AS now FROM events), a AS (SELECT *, epoch(now)::BIGINT - epoch(stored)::BIGINT > 29 * 86400 AS old FROM e, n),
    w AS (SELECT *, NOT old AND sum(size_bytes) FILTER (NOT old) OVER () - coalesce(sum(size_bytes) FILTER (NOT old) OVER (ORDER BY last_access, size_bytes, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1000000 AS gone FROM a)
    SELECT count(*) FILTER (old) AS expired, count(*) FILTER (gone) AS evicted, count(*) FILTER (NOT old AND NOT gone) AS kept, coalesce(sum(size_bytes) FILTER (NOT old AND NOT gone), 0)::BIGINT AS kept_bytes FROM w
""")
def q52_cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upkeep of a cache of users would remove and leave."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = events.agg(F.max("ts")).first()[0]
    stored = events.groupBy(F.sha2(F.col("user_id").cast("string"), 256).alias("cache_key")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("size_bytes"), F.min("ts").alias("stored_at"), F.max("ts").alias("last_access"))
    return cache.cleanup(stored, F.lit(now), 29, 1_000_000)


@query("""
    SELECT event_id, sha256('{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","level":"INFO","event":"' || event_type || '","request_id":"' || event_id || '","fields":{"api_key":"***redacted***","user":"' || user_id || '"}}') AS line FROM events
""")
def q53_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    fields = F.create_map(F.lit("api_key"), F.lit("hush"), F.lit("user"), F.col("user_id").cast("string"))
    lines = log_lines(events, time=F.col("ts"), level=F.lit("INFO"), event=F.col("event_type"), request_id=F.col("event_id").cast("string"), fields=fields)
    return lines.select(F.get_json_object("value", "$.request_id").cast("long").alias("event_id"), F.sha2("value", 256).alias("line"))


@query("SELECT DISTINCT sha256(user_id || '/' || event_type) AS sha256 FROM events")
def q54_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' kinds of events as a stream of contents, each of which passes once."""
    import uuid

    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*").parquet(*_stream_source(sf_dir))
    files = stream.select(F.col("ts").cast("timestamp").alias("modificationTime"), F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), "event_type"), 256).alias("sha256"))
    name = f"sightings_{uuid.uuid4().hex}"
    return run_to_table(first_sightings(files, "400 days").select("sha256"), name, f"{shared_folder(spark)}/{name}", "append")
