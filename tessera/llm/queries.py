"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html_extract, near_dup, packing, pieces, quality, rules, runs, secrets, token_counts, url_filter, whitening
from tessera.llm.common import read


def piece_model() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality.classify(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    learned = rules.train(docs, read(spark, sf_dir, "labels"))
    return rules.statistics(docs).withColumn("kept", rules.verdict(learned)).withColumn("rule", rules.matched(learned))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


#: Entries of the lists, by a hash of the pattern: (list, share of patterns, days listed).
_LISTS = (("block", 3, 90), ("allow", 7, 45))
_YEAR = 365
_DEEPEST = 8


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; the day of its fetch follows from its id."""
    return read(spark, sf_dir, "pages", "page_id", "url").select(
        F.col("page_id").alias("id"), "url", F.pmod(F.col("page_id") * 37, F.lit(_YEAR)).cast("int").alias("day"))


def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries for hosts, their parent domains and path prefixes that the pages have."""
    found = read(spark, sf_dir, "pages", "url").where("url is not null").distinct()
    upto = list(range(1, _DEEPEST + 1))  # labels of a host, segments of a path
    patterns = found.select(F.explode(url_filter.patterns_of(
        url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), upto, upto)).alias("pattern")).distinct()
    number = F.conv(F.substring(F.md5(F.encode("pattern", "UTF-8")), 1, 6), 16, 10).cast("int")
    parts = []
    for k, (name, share, days) in enumerate(_LISTS):
        mine = patterns.where((number % share == k) & (F.length("pattern") > 12)).withColumn("first", number % _YEAR)
        for shift, listed in ((0, True), (days, False), (2 * days, True)):
            parts.append(mine.select(F.lit(name).alias("list"), "pattern", (F.col("first") + shift).alias("day"),
                                     F.lit(listed).alias("listed")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(url_captures(spark, sf_dir), url_entries(spark, sf_dir))
    return judged.select(F.col("id").alias("page_id"), "url", "day", "host", "n_active", "decision", "list", "pattern")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(read(spark, sf_dir, "documents", "doc_id", "text"), piece_model())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.secret_spans(docs, letters=secrets.letter_costs(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.section_tokens(read(spark, sf_dir, "documents", "doc_id", "text"),
                                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_conversations(given.unionByName(own)))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(
        read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.whole_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return whitening.whiten_all(vectors)


_WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def planted_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by a hash of the id, repeat a stretch of their words up to the end.

    A null id has no hash: its text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = documents.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"),
                           (h / 10).cast("long").alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", _WORD_SPLIT), lambda w: w != ""))
    own = own.withColumn("words", words).withColumn("n", F.size("words"))
    start = F.expr("g % greatest(n, 1)").cast("int")
    own = own.withColumn("a", start).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return own.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return runs.run_digests(runs.periodic_runs(docs))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_quality_classifier, op3_html_extraction, op4_quality_rules, op5_near_duplicates,
    op6_url_filters, op7_sentencepiece, op8_token_counts, op9_secret_scan, op10_chat_format,
    op11_best_fit_packing, op12_embedding_whitening, op13_periodic_runs)}


def _op10_sql() -> str:
    controls = chat.CONTROLS
    escaped = "length(x) + length(x) - length(replace(x, '\\', ''))" + "".join(
        f" + (length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in controls)
    size = lambda c: "(" + escaped.replace("(x", f"({c}") + ")"
    u, a = (len(chat.USER_OPEN + chat.USER_CLOSE), len(chat.ASSISTANT_OPEN + chat.ASSISTANT_CLOSE))
    o = len(chat.OTHER_OPEN + chat.OTHER_ROLE + chat.OTHER_CLOSE)
    return f"""
    WITH given AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    marked AS (
      SELECT *, contains(text, '\\') OR CASE role WHEN 'user' THEN contains(text, '{chat.USER_CLOSE}')
             WHEN 'assistant' THEN contains(text, '{chat.ASSISTANT_CLOSE}')
             ELSE contains(role, '\\') OR contains(role, '{chat.OTHER_ROLE}') OR contains(text, '{chat.OTHER_CLOSE}') END AS odd
      FROM given),
    sized AS (
      SELECT *, CASE WHEN odd THEN {size('text')} ELSE length(text) END
             + CASE role WHEN 'user' THEN {u} WHEN 'assistant' THEN {a}
               ELSE {o} + CASE WHEN odd THEN {size('role')} ELSE length(role) END END AS chars
      FROM marked)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """.replace("\\\\", "\\")


_OP1_SQL = """
    WITH own AS (
      SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    item AS (
      SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    win AS (
      SELECT DISTINCT item, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS v
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
    size AS (SELECT DISTINCT n FROM win),
    place AS (
      SELECT r, i, n, w[i:i + n - 1] AS v
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM own, size WHERE len(w) >= n)),
    hit AS (SELECT r, i, place.n, item FROM place JOIN win USING (n, v)),
    words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, list(item ORDER BY item) AS items
              FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
           n_hit IS NOT NULL AS contaminated
    FROM own LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP6_SQL = """
    WITH given AS (
      SELECT page_id, url, CAST((page_id * 37) % 365 AS INTEGER) AS day,
             regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)),
                            '^www\\.|\\.$', '', 'g') AS host,
             regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
      FROM pages),
    split AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS steps FROM given),
    asked AS (
      SELECT page_id, url, day, host, unnest(list_distinct(list_concat(
        list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda k: array_to_string(labels[k:], '.')),
        list_transform(range(1, len(steps) + 1), lambda k: host || '/' || array_to_string(steps[:k], '/'))))) AS pattern
      FROM split WHERE host <> ''),
    pattern AS (
      SELECT DISTINCT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS INTEGER) AS number FROM asked
      WHERE len(string_split(pattern, '/')) <= 9 AND (contains(pattern, '/') OR len(string_split(pattern, '.')) <= 8)),
    entry AS (
      SELECT list, pattern, number % 365 + shift * days AS day, shift <> 1 AS listed
      FROM pattern JOIN (VALUES ('block', 3, 0, 90), ('allow', 7, 1, 45)) l(list, share, k, days) ON number % share = k,
           (VALUES (0), (1), (2)) s(shift) WHERE length(pattern) > 12),
    span AS (
      SELECT list, pattern, day AS from_day, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS to_day, listed FROM entry),
    active AS (
      SELECT a.page_id, a.url, a.day, count(*) AS n_active,
             max({'length': length(a.pattern), 'allow': CAST(s.list = 'allow' AS INTEGER), 'list': s.list, 'pattern': s.pattern}) AS best
      FROM (SELECT DISTINCT page_id, url, day, pattern FROM asked) a JOIN span s ON a.pattern = s.pattern AND s.listed
           AND a.day >= s.from_day AND (s.to_day IS NULL OR a.day < s.to_day)
      GROUP BY ALL)
    SELECT g.page_id, g.url, g.day, g.host, coalesce(n_active, 0) AS n_active,
           CASE WHEN best IS NULL THEN 'none' WHEN best.allow = 1 THEN 'allow' ELSE 'block' END AS decision,
           best.list AS list, best.pattern AS pattern
    FROM given g LEFT JOIN active a ON g.page_id = a.page_id AND g.url = a.url AND g.day = a.day
"""

_OP13_SQL = """
    WITH own AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda k: 0::BIGINT)),
                 lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) AS h
      FROM documents),
    sized AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM own),
    planted AS (
      SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n),
               lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END])
             ELSE w END AS w FROM sized),
    word AS (SELECT r, n, unnest(w) AS v, unnest(range(0, n)) AS i FROM planted),
    same AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.v = y.v AND y.i > x.i
             AND 4 * (y.i - x.i) <= x.n),
    island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same),
    stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY r, q, g
                HAVING count(*) + q >= greatest(6, 4 * q)),
    run AS (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length),
    listed AS (
      SELECT r, count(*) AS n_runs, min({'a': -length, 'start': start, 'period': period}) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM run GROUP BY r),
    gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
    kept AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.a AS length, best.period AS period,
           -1000 * best.a // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
           sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM planted LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op13_periodic_runs": _OP13_SQL, "op1_decontamination": _OP1_SQL, "op6_url_filters": _OP6_SQL, "op10_chat_format": _op10_sql()}
