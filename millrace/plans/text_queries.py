"""Text, record and payload queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions import times, validation
from millrace.functions.nested import map_strings
from millrace.operators import claims, logs
from millrace.plans import views as V
from millrace.plans.base import query
from millrace.sources import tables

_EMAIL = r"'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'"


def redact_sql(c: str) -> str:
    """The redaction patterns as nested DuckDB calls."""
    # The patterns of functions/text.py in DuckDB's syntax, in the order in which they run.
    rules = [
        (_EMAIL, "'[EMAIL_REDACTED]'", "g"),
        (r"'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+'", "'[JWT_REDACTED]'", "g"),
        ("'sk-[a-zA-Z0-9]{20,}'", "'[API_KEY_REDACTED]'", "g"),
        ("'sk-ant-[a-zA-Z0-9_-]{20,}'", "'[API_KEY_REDACTED]'", "g"),
        (r"'(?:token|key|secret|password|authorization)[=: ]+[''\"]?([A-Za-z0-9_/+=.-]{40,})'", "'[SECRET_REDACTED]'", "gi"),
        (r"'Bearer\s+[A-Za-z0-9._~+/=-]{10,}'", "'Bearer [TOKEN_REDACTED]'", "g"),
        (
            r"'(password|passwd|pwd|secret_key|api_key|apikey|auth_token|access_token|refresh_token)[\s]*[=:]\s*[''\"]?\S+[''\"]?'",
            r"'\1=[REDACTED]'",
            "gi",
        ),
    ]
    for pattern, replacement, flags in rules:
        c = f"regexp_replace({c}, {pattern}, {replacement}, '{flags}')"
    return c


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT id, lower({_STRIP.format('email')}) AS email FROM raw_accounts")
def normalize_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.raw_accounts(spark, sf_dir).select("id", X.normalize_email(F.col("email")).alias("email"))


@query(f"SELECT id, {redact_sql('text')} AS text FROM messages")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.messages(spark, sf_dir).select("id", X.redact(F.col("text")).alias("text"))


@query(f"""
SELECT id, {redact_sql('text')} AS in_struct, {redact_sql('text')} AS in_map, {redact_sql('lang')} AS in_array, text AS too_deep FROM
(SELECT doc_id AS id, text, source || '@example.com' AS lang FROM documents)
""")
def redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, mail = F.col("text"), F.concat("source", F.lit("@example.com"))
    deep = F.array(F.array(F.array(F.array(F.array(text)))))
    value = F.struct(text.alias("s"), F.create_map(F.lit("password=xxxxxxxx"), text).alias("m"), F.array(F.struct(mail.alias("a"))).alias("l"))
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), value.alias("v"), deep.alias("d"))
    docs = docs.withColumns({c: map_strings(F.col(c), docs.schema[c].dataType, X.redact) for c in ("v", "d")})
    key = F.lit("password=xxxxxxxx")
    return docs.select(
        "id", F.col("v.s").alias("in_struct"), F.col("v.m")[key].alias("in_map"), F.col("v.l")[0]["a"].alias("in_array"), F.col("d")[0][0][0][0][0].alias("too_deep")
    )


@query(r"""
, cut AS (SELECT id, substr(regexp_replace(request_id, '^\s+|\s+$', '', 'g'), 1, 64) AS r FROM requests)
SELECT id, CASE WHEN regexp_matches(r, '^[\p{L}\p{N}_-]+\z') THEN r ELSE md5(id::VARCHAR) END AS request_id FROM cut
""")
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    minted = F.md5(F.col("id").cast("string").cast("binary"))
    return V.requests(spark, sf_dir).select("id", F.coalesce(X.request_id(F.col("request_id")), minted).alias("request_id"))


@query("""
SELECT p_partkey AS id, array_to_string(list_filter(string_split(p_type || ', ,' || p_brand || ' ,', ' '), lambda x: x <> ''), ' ') AS words,
  array_to_string(list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS listed FROM part
""")
def parse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_type", F.lit(", ,"), "p_brand", F.lit(" ,"))
    words = F.array_join(F.filter(F.split(text, " "), lambda x: x != ""), " ")
    listed = F.array_join(X.parse_list(text), "|")
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words.alias("words"), listed.alias("listed"))


@query(r"""
SELECT page_id AS id, array_to_string(list_append([regexp_replace(regexp_replace(url, '^(https?://[^/]+).*$', '\1/'), '/+$', '')], 'http://localhost:5173'), ',') AS origins FROM pages
""")
def origin_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.regexp_replace("url", "^(https?://[^/]+).*$", "$1/")
    origins = F.concat(X.without_trailing_slash(X.parse_list(site)), F.array(F.lit("http://localhost:5173")))
    return V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array_join(origins, ",").alias("origins"))


@query("SELECT id, 'client=' || client || ',status=' || status AS extra FROM requests")
def extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    standard = ["name", "msg", "args", "levelname", "lineno", "asctime", "message", "taskName"]
    text = lambda c: F.col(c).cast("string")
    fields = F.create_map(F.lit("msg"), text("path"), F.lit("status"), text("status"), F.lit("client"), text("client"), F.lit("lineno"), text("id"))
    extra = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: ~k.isin(standard))))
    shown = F.array_join(F.transform(extra, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return V.requests(spark, sf_dir).select("id", shown.alias("extra"))


@query("""
, bodies AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN '{"detail":[{"msg":"bad ' || event_id || '"}]}' WHEN 'view' THEN '{"detail":"gone ' || user_id || '"}'
   WHEN 'signup' THEN '{"detail":[]}' WHEN 'purchase' THEN '{"detail":""}' ELSE '{}' END AS body FROM events)
SELECT id, coalesce(json_extract_string(body, '$.detail[0].msg'), nullif(json_extract_string(body, '$.detail'), ''), 'Something went wrong.') AS message FROM bodies
""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    body = (
        F.when(kind == "click", F.format_string('{"detail":[{"msg":"bad %d"}]}', "event_id"))
        .when(kind == "view", F.format_string('{"detail":"gone %d"}', "user_id"))
        .when(kind == "signup", '{"detail":[]}')
        .when(kind == "purchase", '{"detail":""}')
        .otherwise("{}")
    )
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), X.error_message(body, "Something went wrong.").alias("message"))


@query("""
SELECT p_partkey AS id, upper(substr(string_split(p_name, ' ')[1], 1, 1) || coalesce(substr(string_split(p_name, ' ')[2], 1, 1), '')) AS initials FROM part
""")
def initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.initials(F.col("p_name")).alias("initials"))


@query(r"SELECT doc_id AS id, regexp_replace(regexp_replace(lower(text), '\s+', '-', 'g'), '[^0-9A-Za-z_-]+', '', 'g') AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.messages(spark, sf_dir).select("id", X.slug(F.col("text")).alias("slug"))


@query(r"""
SELECT id, 'skip=' || (id % 7) || CASE WHEN description IS NOT NULL THEN '&tag=' || url_encode(title) || '&tag=' || description ELSE '&tag=' || url_encode(title) END
  || '&' || url_encode('by[owner]') || '=' || owner_id AS query FROM items
""")
def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = {
        "skip": ((F.col("id") % 7).cast("string"), "scalar"),
        "none": (F.lit(None).cast("string"), "scalar"),
        "tag": (F.array("title", "description"), "array"),
        "by": (F.create_map(F.lit("owner"), F.col("owner_id").cast("string"), F.lit("gone"), F.lit(None).cast("string")), "map"),
    }
    query_string = X.query_string(parameters)
    return V.items(spark, sf_dir).select("id", F.substring(query_string, 2, F.length(query_string)).alias("query"))


@query(r"""
SELECT event_id AS id, 'q%20name=' || event_type || '&filter%5Bk%5D=' || (props->>'$.k') || '&filter%5Btags%5D=a%2Fb&filter%5Btags%5D=' || event_type
  || '&filter%5Bowner%5D%5Bid%5D=' || user_id || CASE WHEN event_id % 2 = 0 THEN '&on=true' ELSE '' END AS query FROM events
""")
def nested_query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters whose names need encoding and whose values are nested."""
    owner = F.struct(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("name"))
    nested = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.array(F.lit("a/b"), F.col("event_type"), F.lit(None).cast("string")).alias("tags"), owner.alias("owner"))
    rows = V.table(spark, sf_dir, "events").select("event_id", "event_type", nested.alias("filter"), F.when(F.col("event_id") % 2 == 0, True).alias("on"))
    types = {f.name: f.dataType for f in rows.schema}
    parameters = {"q name": (F.col("event_type"), "scalar"), "filter": (F.col("filter"), types["filter"]), "on": (F.col("on"), types["on"])}
    query = X.query_string(parameters)
    return rows.select(F.col("event_id").alias("id"), F.substring(query, 2, F.length(query)).alias("query"))


@query("""
SELECT id, '/api/v1/items/' || id || '/owners/' || owner_id || '/' || url_encode(title) || '%20%7Bowner%7D/a?b%25/{version}' AS path FROM items
""")
def path_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are encoded as parts of a URI; a value that looks like a placeholder stays as it is."""
    tag = F.concat("title", F.lit(" {owner}/a?b%"))
    values = {"id": F.col("id").cast("string"), "owner": F.col("owner_id").cast("string"), "tag": tag}
    path = X.fill(F.lit("/api/v1/items/{id}/owners/{owner}/{tag}/{version}"), values, encode=X.encode_uri)
    return V.items(spark, sf_dir).select("id", path.alias("path"))


@query("SELECT id, '<p>Hello ' || coalesce(full_name || ' {{ email }}', '') || ', your account ' || email || ' is ready.</p>{{ link }}' AS html FROM accounts")
def mail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some names look like a placeholder, and stay."""
    template = F.lit("<p>Hello {{ username }}, your account {{ email }} is ready.</p>{{ link }}")
    html = X.fill(template, {"username": F.concat("full_name", F.lit(" {{ email }}")), "email": F.col("email")}, "{{ ", " }}")
    return V.accounts(spark, sf_dir).select("id", html.alias("html"))


@query("""
SELECT event_id AS id, strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN epoch_us(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END) % 1000000 = 0 THEN ''
     ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS iso FROM events
""")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), times.iso(ts).alias("iso"))


@query("SELECT o_orderkey AS id, sha256('t' || o_orderkey) AS digest FROM orders")
def token_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return V.table(spark, sf_dir, "orders").select(k.alias("id"), F.sha2(F.concat(F.lit("t"), k.cast("string")), 256).alias("digest"))


@query("""
SELECT event_id AS id, ts + INTERVAL 8 DAYS AS access_until, ts + INTERVAL 30 DAYS AS refresh_until, ts + INTERVAL 48 HOURS AS reset_until FROM events
""")
def expiry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = lambda kind: times.expires_at(F.col("ts"), kind)
    return V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), until("access").alias("access_until"), until("refresh").alias("refresh_until"), until("password_reset").alias("reset_until")
    )


@query(rf"""
, r AS (SELECT id, {_STRIP.format('email')} AS email, role, password, full_name FROM raw_accounts)
SELECT id, array_to_string(list_filter([
  CASE WHEN email IS NULL THEN 'email:missing' END,
  CASE WHEN NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$') THEN 'email:value_error' END,
  CASE WHEN length(email) > 255 THEN 'email:string_too_long' END,
  CASE WHEN length(full_name) > 255 THEN 'full_name:string_too_long' END,
  CASE WHEN role NOT IN ('admin', 'user') THEN 'role:enum' END,
  CASE WHEN length(password) < 8 THEN 'password:string_too_short' END,
  CASE WHEN length(password) > 128 THEN 'password:string_too_long' END], lambda x: x IS NOT NULL), ',') AS errors FROM r
""")
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.raw_accounts(spark, sf_dir).withColumn("email", X.strip(F.col("email")))
    return _checked(rows, validation.account_rules())


def _checked(rows: DataFrame, rules: list[validation.Rule]) -> DataFrame:
    checked = validation.check(rows, rules)
    shown = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["loc"], e["type"])), ",")
    good, bad = validation.accepted(checked), validation.rejected(checked)
    return good.select("id", F.lit("").alias("errors")).unionByName(bad.select("id", shown.alias("errors")))


_TITLE = "CASE WHEN id % 10 <> 0 THEN repeat(title, (id % 60)::INT) END"
_DESCRIPTION = "repeat(description, (id % 300)::INT)"


@query(f"""
, r AS (SELECT id, {_TITLE} AS title, {_DESCRIPTION} AS description FROM items)
SELECT id, array_to_string(list_filter([
  CASE WHEN title IS NULL THEN 'title:missing' END,
  CASE WHEN length(title) < 1 THEN 'title:string_too_short' END,
  CASE WHEN length(title) > 255 THEN 'title:string_too_long' END,
  CASE WHEN length(description) > 255 THEN 'description:string_too_long' END], lambda x: x IS NOT NULL), ',') AS errors FROM r
""")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose titles and descriptions are repeated by their id, so that some are missing, empty or too long."""
    k = F.col("id")
    rows = V.items(spark, sf_dir).select(
        "id",
        F.when(k % 10 != 0, F.expr("repeat(title, cast(id % 60 AS INT))")).alias("title"),
        F.expr("repeat(description, cast(id % 300 AS INT))").alias("description"),
    )
    return _checked(rows, validation.item_rules())


@query("""
SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k,
  CASE WHEN event_id % 10 = 0 THEN props || '}x' END AS corrupt FROM events
""")
def parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    rows = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), broken.alias("body"))
    parsed = tables.parse_payload(rows, "body", T.StructType([T.StructField("k", T.LongType())]))
    corrupt = F.when(F.col("_corrupt").isNotNull(), F.concat(F.substring("_corrupt", 2, F.length("_corrupt")), F.lit("}x")))
    return parsed.select("id", "k", corrupt.alias("corrupt"))


@query("""
SELECT id, '{"id":' || id || ',"title":"' || title || '","description":' || CASE WHEN description IS NULL THEN 'null' ELSE '"' || description || '"' END
  || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00"}' AS payload FROM items
""")
def to_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.items(spark, sf_dir).select("id", "title", "description", "created_at")
    return rows.select("id", tables.to_payload(rows).alias("payload"))


@query("SELECT id, title, owner_id FROM items")
def write_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.items(spark, sf_dir).select("id", "title", "owner_id")
    path = tables.shared_path(spark, "batches")
    tables.write_batch(rows.filter("id % 2 = 0"), path, "1")
    return tables.write_batch(rows, path, "1")  # a replay of the batch replaces it


@query(f"""
SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || rpad(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, 8, ' ') || ' api.access ['
  || CASE WHEN event_id % 10 = 0 THEN '-' ELSE 'r-' || event_id END || '] ' || event_type || ' by [EMAIL_REDACTED]' AS line FROM events
""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    request = F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("r-"), k.cast("string")))
    message = F.format_string("%s by user%d@example.com", "event_type", "user_id")
    line = tables.log_line(F.col("ts"), level, F.lit("api.access"), request, message)
    return V.table(spark, sf_dir, "events").select(k.alias("id"), line.alias("line"))


@query("""
, claims AS (SELECT CASE event_type WHEN 'click' THEN 'access' WHEN 'view' THEN 'refresh' ELSE 'password_reset' END AS type,
   CASE WHEN event_id % 4 = 0 AND epoch(ts)::BIGINT + 30 > epoch(TIMESTAMP '2024-01-10') THEN 'not_yet_valid'
     WHEN epoch(ts)::BIGINT + 60 <= epoch(TIMESTAMP '2024-01-10') THEN 'expired' ELSE 'valid' END AS state FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events))
SELECT type, state, count(*) AS n FROM claims GROUP BY type, state
""")
def claims_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.audit(V.tokens(spark, sf_dir), F.lit("2024-01-10").cast("timestamp"))


_SECRET = "'mail u' || user_id || '@example.com'"


@query(f"""
SELECT event_id AS id, 'mail [EMAIL_REDACTED]' AS message, 'mail [EMAIL_REDACTED]' AS arg, {_SECRET} AS inner_arg, 'mail [EMAIL_REDACTED]' AS extra, {_SECRET} AS deep,
  'Traceback: mail [EMAIL_REDACTED]' AS traceback FROM events
""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole log records: of the arguments only the top level is redacted, of the extra fields four containers."""
    secret = F.format_string("mail u%d@example.com", "user_id")
    five = F.array(F.array(F.array(F.array(secret))))
    records = V.table(spark, sf_dir, "events").select(
        "event_id",
        secret.alias("message"),
        F.struct(secret.alias("a"), F.array(secret).alias("b")).alias("args"),
        F.struct(F.create_map(F.lit("k@example.com"), secret).alias("m"), five.alias("five")).alias("extra"),
        F.concat(F.lit("Traceback: "), secret).alias("traceback"),
    )
    done = logs.redact_records(records, extra="extra")
    return done.select(
        F.col("event_id").alias("id"), "message", F.col("args.a").alias("arg"), F.col("args.b")[0].alias("inner_arg"),
        F.col("extra.m")["k@example.com"].alias("extra"), F.col("extra.five")[0][0][0][0].alias("deep"), "traceback",
    )


@query(f"""
SELECT doc_id AS id, {redact_sql('text')} AS shallow, {redact_sql('text')} AS inner_text, text AS deep, '1.50' AS number, {redact_sql("'mail a@b.co {'")} AS plain FROM documents
""")
def redact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON whose shape differs from row to row: every other one has a list where the others have an object."""
    deep = F.array(F.array(F.array(F.array("text"))))
    one = F.to_json(F.struct(F.col("text").alias("a"), F.struct(F.array(F.struct(F.col("text").alias("t"))).alias("l")).alias("b"), F.struct(deep.alias("d")).alias("c")))
    other = F.to_json(F.struct(F.col("text").alias("a"), F.struct(F.array(F.struct(F.col("text").alias("t"), F.lit(True).alias("u"))).alias("l")).alias("b"), F.struct(deep.alias("d"), F.lit(None).cast("int").alias("e")).alias("c")))
    shaped = F.when(F.col("doc_id") % 2 == 0, one).otherwise(other)
    body = F.regexp_replace(shaped, r"\}$", r',"n": 1.50}')
    rows = V.table(spark, sf_dir, "documents").select("doc_id", logs.redact_json(body).alias("j"), logs.redact_json(F.lit("mail a@b.co {")).alias("plain"))
    part = lambda path: F.get_json_object("j", path)
    number = F.regexp_extract("j", r'"n": ([0-9.]+)\}$', 1)
    return rows.select(
        F.col("doc_id").alias("id"), part("$.a").alias("shallow"), part("$.b.l[0].t").alias("inner_text"), part("$.c.d[0][0][0][0]").alias("deep"), number.alias("number"), "plain"
    )
