"""Queries: linking, hashing, similarity, redaction."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import numbers as N
from recollect.functions import privacy as R
from recollect.functions import text as T
from recollect.operators import dedup as D
from recollect.operators import redact as X
from recollect.operators import retrieval as RV
from recollect.operators import similar as SM
from recollect.plans import sql as S
from recollect.plans.registry import query
from recollect.sources import views as V

COS = """(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
  / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))
   * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)))))"""
LAGGED = ("lagged", """SELECT *, lag(app_name) OVER w AS p_app, lag(window_title) OVER w AS p_title,
   lag(embedding) OVER w AS p_emb FROM {src} WINDOW w AS (PARTITION BY stream ORDER BY time_start, seq)""")
MARKED = ("marked", f"""SELECT *, max(CASE WHEN NOT linked THEN seq END) OVER (PARTITION BY stream
   ORDER BY time_start, seq) AS fact FROM (SELECT *, coalesce(CASE WHEN p_app = app_name AND p_title = window_title
     THEN {COS.format(a='p_emb', b='embedding')} >= 0.90 END, false) AS linked FROM lagged)""")


def lagged(src):
    return (LAGGED[0], LAGGED[1].format(src=src))


@query("chronos_link", S.with_views("l0tv", lagged("l0tv"), MARKED, body="""SELECT stream, fact, min(time_start) AS time_start,
   max(time_end) AS time_end, any_value(app_name) AS app_name, any_value(window_title) AS window_title,
   md5(arg_min(text, time_start)) AS text_md5, count(*) - 1 AS deltas FROM marked GROUP BY stream, fact"""))
def chronos_link(spark, d):
    facts = D.chronos_facts(D.mark_links(V.memory(spark, d, vectors=True)), lambda rows: V.with_text(rows, spark, d))
    return facts.select("stream", "fact", "time_start", "time_end", "app_name", "window_title",
                        F.md5("text").alias("text_md5"), "deltas")


@query("delta_timeline", S.with_views("l0tv", lagged("l0tv"), MARKED, body="""SELECT stream, fact,
   epoch_us(time_start) AS t, md5(text) AS text_md5 FROM marked WHERE linked"""))
def delta_timeline(spark, d):
    rows = D.chronos_deltas(D.mark_links(V.memory(spark, d, vectors=True)), lambda rows: V.with_text(rows, spark, d))
    return rows.select("stream", "fact", "t", F.md5("text").alias("text_md5"))


@query("stability_rate", S.with_views("l0v", lagged("l0v"), MARKED, body="""SELECT count(*) AS total,
   count(*) FILTER (linked) AS linked, round(avg(linked::INT) * 100, 6) AS stability_pct FROM marked"""))
def stability_rate(spark, d):
    return D.stability_rate(D.mark_links(V.memory(spark, d, vectors=True)))


@query("cosine_similarity", f"""SELECT a.vec_id, round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine
   FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, d):
    v = V.table(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(D.cosine("embedding", "_next"), 6).alias("cosine"))


HASH_RADIUS = 10


def hash_sql(cells):
    """Signed 64-bit value of the average hash of a list."""
    raw = (f"list_sum(list_transform({cells}, lambda x, i: CASE WHEN x > list_sum({cells})::BIGINT // len({cells}) "
           f"THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END))")
    return f"(CASE WHEN {raw} >= (1::HUGEINT << 63) THEN {raw} - (1::HUGEINT << 64) ELSE {raw} END)::BIGINT"


FRAMES = ("frames", f"""SELECT stream, time_start, seq, app_name, {hash_sql('cells')} AS phash,
   list_transform([0, 1, 2, 3], lambda b: list_sum(list_transform(cells[b * 16 + 1:b * 16 + 16],
     lambda x, i: CASE WHEN x > list_sum(cells[b * 16 + 1:b * 16 + 16])::BIGINT // 16
       THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT) AS blocks FROM cells""")


@query("average_hash", f"""SELECT vec_id, {hash_sql('cells')} AS hash FROM (SELECT vec_id, list_transform(embedding,
   lambda x: floor((x::DOUBLE + 1.0) * 1000)::BIGINT) AS cells FROM embeddings)""")
def average_hash(spark, d):
    v = V.table(spark, d, "embeddings")
    return v.select("vec_id", D.average_hash(F.transform("embedding", V.grey)).alias("hash"))


BLOCK_HASH = ("hashes", """SELECT frame, block, (CASE WHEN h >= (1::HUGEINT << 63) THEN h - (1::HUGEINT << 64)
   ELSE h END)::BIGINT AS hash FROM (SELECT frame, block, sum(CASE WHEN value > mean AND pos < 64
     THEN 1::HUGEINT << pos::INT ELSE 0::HUGEINT END) AS h FROM (SELECT *, (sum(value) OVER (PARTITION BY frame, block))::BIGINT
       // count(*) OVER (PARTITION BY frame, block) AS mean FROM blocks) GROUP BY ALL)""")


@query("block_hashes", S.with_views("blocks", BLOCK_HASH, body="SELECT frame, block, hash FROM hashes"))
def block_hashes(spark, d):
    return D.block_hashes(V.blocks(spark, d))


@query("changed_block_ratio", S.with_views("blocks", BLOCK_HASH, body="""SELECT b.frame,
   round(avg((bit_count(xor(a.hash, b.hash)) > 5)::INT), 6) AS ratio FROM hashes a JOIN hashes b
   ON b.frame = a.frame + 1 AND b.block = a.block GROUP BY b.frame"""))
def changed_block_ratio(spark, d):
    return D.changed_block_ratio(D.block_hashes(V.blocks(spark, d)))


@query("hamming_near_dups", S.with_views("cells", FRAMES, body="""SELECT stream, count(*) AS frames,
   count(*) FILTER (near) AS near FROM (SELECT stream, bit_count(xor(phash, lag(phash) OVER (PARTITION BY stream
     ORDER BY time_start, seq))) < CASE WHEN """ + S.has_any("lower(app_name)", rules.TIGHT_HASH_APPS)
       + " THEN 2 ELSE 5 END AS near FROM frames) GROUP BY stream"))
def hamming_near_dups(spark, d):
    rows = D.hamming_near_dups(D.hash_frames(V.frames(spark, d)))
    return rows.groupBy("stream").agg(F.count(F.lit(1)).alias("frames"), F.count_if("near").alias("near"))


@query("frame_gate", S.with_views("cells", FRAMES, ("ordered", """SELECT *, row_number() OVER (PARTITION BY stream
   ORDER BY time_start, seq) AS n, CASE WHEN """ + S.has_any("lower(app_name)", rules.TIGHT_HASH_APPS) + """
   THEN 2 ELSE 5 END AS need FROM frames"""), body="""SELECT stream, seq FROM walk WHERE ok""").replace(
    "WITH ", "WITH RECURSIVE ", 1).replace("SELECT stream, seq FROM walk WHERE ok", """
   , walk AS (
     SELECT stream, n, seq, bit_count(phash) >= need AS ok,
       CASE WHEN bit_count(phash) >= need THEN phash ELSE 0 END AS last,
       CASE WHEN bit_count(phash) >= need THEN blocks ELSE [0, 0, 0, 0]::BIGINT[] END AS lastb
     FROM ordered WHERE n = 1
     UNION ALL
     SELECT stream, n, seq, ok, CASE WHEN ok THEN phash ELSE last END, CASE WHEN ok THEN blocks ELSE lastb END
     FROM (SELECT o.*, w.last, w.lastb,
        bit_count(xor(o.phash, w.last)) >= o.need AND NOT (list_bool_or(list_transform(w.lastb, lambda x: x <> 0))
          AND list_sum(list_transform(list_zip(w.lastb, o.blocks),
              lambda z: (bit_count(xor(z[1], z[2])) > 5)::INT)) / 4.0 < 0.05) AS ok
        FROM walk w JOIN ordered o ON o.stream = w.stream AND o.n = w.n + 1))
   SELECT stream, seq FROM walk WHERE ok"""))
def frame_gate(spark, d):
    return D.frame_gate(D.hash_frames(V.frames(spark, d))).filter("accepted").select("stream", "seq")


WORD_SET = "list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: strlen(w) > 2), lambda w: lower(w)))"


@query("word_set", f"""SELECT doc_id, len({WORD_SET}) AS n, md5(array_to_string(list_sort({WORD_SET}), ' ')) AS words
   FROM documents""")
def word_set(spark, d):
    docs = V.documents(spark, d).select("doc_id", T.word_set("text").alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n"),
                       F.md5(F.array_join(F.array_sort("w"), " ")).alias("words"))


SCORE = "len(list_intersect(e.w, s.w)) / len(list_distinct(list_concat(e.w, s.w)))::DOUBLE"


@query("jaccard_cache_join", S.with_views("asks", ("q", f"""SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY us, query_id) AS n FROM (
   SELECT conv_id * 1000000000 + turn AS query_id, conv_id, epoch_us(ts) AS us, {WORD_SET} AS w FROM asks)"""),
   ("walk", f"""SELECT conv_id, n, query_id, NULL::BIGINT AS hit_id, NULL::DOUBLE AS s, [{{'id': query_id, 'us': us, 'w': w}}] AS cache FROM q WHERE n = 1
   UNION ALL SELECT conv_id, n, query_id, hit.id, hit.s, CASE WHEN hit IS NULL THEN list_append(live, {{'id': query_id, 'us': us, 'w': w}})[-20:] ELSE live END
   FROM (SELECT s.*, live, list_filter(list_transform(live, lambda e: CASE WHEN len(s.w) > 0 AND len(e.w) > 0 THEN {{'id': e.id, 's': {SCORE}}} END),
     lambda h: h.s >= 0.85)[1] AS hit FROM (SELECT s.*, list_filter(c.cache, lambda e: s.us - e.us < 300000000) AS live
       FROM walk c JOIN q s ON s.conv_id = c.conv_id AND s.n = c.n + 1) s)"""),
   body="SELECT query_id, hit_id, round(s, 6) AS similarity FROM walk WHERE hit_id IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1))
def jaccard_cache_join(spark, d):
    q = V.asks(spark, d).withColumn("query_id", F.col("conv_id") * 1_000_000_000 + F.col("turn"))
    return D.jaccard_cache_join(q, "conv_id")


SETS = [("sets", f"SELECT doc_id, list_sort({WORD_SET}) AS w FROM documents"),
        ("classes", "SELECT w, min(doc_id) AS class_id, len(w) AS n FROM sets WHERE len(w) > 0 GROUP BY w"),
        ("words", "SELECT class_id, n, unnest(w) AS word FROM classes"),
        ("pairs", """SELECT x.class_id AS a, y.class_id AS b, count(*) AS common, count(*) / (x.n + y.n - count(*)) AS similarity
   FROM words x JOIN words y ON x.word = y.word AND x.class_id < y.class_id GROUP BY x.class_id, y.class_id, x.n, y.n
   HAVING count(*) * 185 >= (x.n + y.n) * 85""")]


def set_rows(spark, d):
    return V.documents(spark, d).select("doc_id", T.word_set("text").alias("w"))


@query("similar_sets", S.with_views(*SETS, body="SELECT a, b, common, round(similarity, 9) AS similarity FROM pairs"))
def similar_sets(spark, d):
    """Pairs of word sets (by the smallest document of each) at 0.85 or more."""
    pairs, _ = SM.similar_sets(set_rows(spark, d), "doc_id", "w", 0.85)
    return pairs.withColumn("similarity", F.round("similarity", 9))


def groups_sql(pairs, members):
    """Rows of `members` with links and the smallest class reachable over `pairs`."""
    return [("ends", f"SELECT a, b FROM {pairs} UNION ALL SELECT b, a FROM {pairs}"),
            ("reach", """SELECT class_id AS a, class_id AS c FROM (SELECT DISTINCT class_id FROM members)
   UNION SELECT e.b, r.c FROM reach r JOIN ends e ON e.a = r.a WHERE r.c < e.b"""),
            ("least", "SELECT a, min(c) AS component_id FROM reach GROUP BY a"),
            ("degree", "SELECT a, count(*) AS links FROM ends GROUP BY a")]


GROUPED = """SELECT m.key, m.class_id, coalesce(links, 0) AS links, component_id FROM members m
   JOIN least l ON l.a = m.class_id LEFT JOIN degree g ON g.a = m.class_id"""


@query("similar_set_groups", S.with_views(*SETS, ("members", "SELECT doc_id AS key, class_id FROM sets JOIN classes USING (w)"),
    *groups_sql("pairs", "members"), body=GROUPED).replace("WITH ", "WITH RECURSIVE ", 1))
def similar_set_groups(spark, d):
    return SM.linked(*SM.similar_sets(set_rows(spark, d), "doc_id", "w", 0.85))


HASHED = ("hashed", f"""SELECT vec_id AS key, {hash_sql('cells')} AS h FROM (SELECT vec_id, list_transform(embedding,
   lambda x: floor((x::DOUBLE + 1.0) * 1000)::BIGINT) AS cells FROM embeddings)""")


@query("hamming_groups", S.with_views(HASHED, ("members", "SELECT key, min(key) OVER (PARTITION BY h) AS class_id, h FROM hashed"),
    ("pairs", f"""SELECT x.key AS a, y.key AS b FROM members x JOIN members y ON x.key = x.class_id AND y.key = y.class_id
   AND x.key < y.key AND bit_count(xor(x.h, y.h)) <= {HASH_RADIUS}"""), *groups_sql("pairs", "members"), body=GROUPED)
       .replace("WITH ", "WITH RECURSIVE ", 1))
def hamming_groups(spark, d):
    """All pairs of image hashes within the radius, as links and groups of every vector."""
    v = V.table(spark, d, "embeddings").select("vec_id", D.average_hash(F.transform("embedding", V.grey)).alias("h"))
    return SM.linked(*SM.near_hashes(v, "vec_id", "h", HASH_RADIUS))


@query("embed_once", S.with_views("l0t", body=f"""SELECT count(*) AS n_rows, count(DISTINCT seq) AS n_ids,
   count(*) AS with_vector, sum(len({S.words('text')}) * (seq % 1000 + 1))::BIGINT AS counted FROM l0t"""))
def embed_once(spark, d):
    """Every row gets the vector of its own text: entries add up to its words, weighted by the row."""
    m = V.memory(spark, d, text=True).select("seq", "text")
    out = D.embed_once(m, "text", lambda t: RV.embed_text(t, "text"))
    words = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).cast("bigint")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("seq").alias("n_ids"),
                   F.count_if(F.size("embedding") == 384).alias("with_vector"),
                   F.sum(words * (F.col("seq") % 1000 + 1)).alias("counted"))


@query("dedup_lines_topn", S.with_views("qa", ("l", f"""SELECT conv_id, turn, unnest(string_split(src, chr(10))) AS line,
   generate_subscripts(string_split(src, chr(10)), 1) AS i FROM (SELECT conv_id, turn,
     CASE WHEN {S.trim('answer')} <> '' THEN answer ELSE question END AS src FROM qa)"""), body=f"""
   SELECT q.conv_id, q.turn, coalesce('Raw:' || chr(10) || chr(10) || t.body, {S.lit(rules.NO_MATCH_LINE)}) AS body
   FROM qa q LEFT JOIN (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS body FROM (
     SELECT * FROM (SELECT conv_id, turn, {S.trim('line')} AS line, min(i) AS i FROM l
       WHERE {S.trim('line')} <> '' GROUP BY 1, 2, 3)
     QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 8) GROUP BY 1, 2) t USING (conv_id, turn)"""))
def dedup_lines_topn(spark, d):
    return V.qa_pairs(spark, d).select("conv_id", "turn", T.dedup_lines_topn(
        "question", "answer", "Raw:").alias("body"))


# --- privacy -------------------------------------------------------------------

def secret_docs(spark, d):
    """Documents; two in three carry a credential-like token at the end."""
    k = F.col("doc_id") % 3
    extra = (F.when(k == 0, F.concat(F.lit("\nkey GHP_"), F.lpad(F.col("doc_id").cast("string"), 24, "x"), F.lit("  end")))
             .when(k == 1, F.concat(F.lit(" 0x"), F.repeat(F.lit("aB"), 20), F.lit("\tcard 4242-4242 4242 4242.")))
             .otherwise(F.lit(" 0xabc")))
    return V.documents(spark, d).select("doc_id", "source", "lang", F.concat("text", extra).alias("text"))


SECRET_DOCS = ("sdocs", """SELECT doc_id, source, lang, text || CASE doc_id % 3
   WHEN 0 THEN chr(10) || 'key GHP_' || lpad(doc_id::VARCHAR, 24, 'x') || '  end'
   WHEN 1 THEN ' 0x' || repeat('aB', 20) || chr(9) || 'card 4242-4242 4242 4242.' ELSE ' 0xabc' END AS text FROM documents""")
IS_TOKEN = ("(strlen(p) >= 20 AND (" + S.starts("lower(p)", rules.TOKEN_PREFIXES)
            + " OR regexp_full_match(p, '0[xX][0-9a-fA-F]{40,}') OR regexp_full_match(p, '[0-9a-fA-F]{48,}')))")
TOKENS = "regexp_extract_all({x}, '\\S+|\\s+')"
DIGITS = "regexp_extract_all({x}, '[0-9](?:[ -]?[0-9])*|[^0-9]+')"
IS_CARD = """(regexp_matches(p, '^[0-9]') AND length(regexp_replace(p, '[ -]', '', 'g')) BETWEEN 13 AND 19
  AND list_sum(list_transform(string_split(reverse(regexp_replace(p, '[ -]', '', 'g')), ''), lambda c, i:
    CASE WHEN i % 2 = 1 THEN TRY_CAST(c AS INT) WHEN TRY_CAST(c AS INT) * 2 > 9 THEN TRY_CAST(c AS INT) * 2 - 9
      ELSE TRY_CAST(c AS INT) * 2 END)) % 10 = 0)"""


def scrub_tokens_sql(x):
    return f"array_to_string(list_transform({TOKENS.format(x=x)}, lambda p: CASE WHEN {IS_TOKEN} THEN '{rules.KEY_MARK}' ELSE p END), '')"


def scrub_cards_sql(x):
    return f"array_to_string(list_transform({DIGITS.format(x=x)}, lambda p: CASE WHEN {IS_CARD} THEN '{rules.CARD_MARK}' ELSE p END), '')"


@query("scrub_tokens", S.with_views(SECRET_DOCS, body=f"""SELECT doc_id, md5({scrub_tokens_sql('text')}) AS clean,
   {scrub_tokens_sql('text')} <> text AS changed FROM sdocs"""))
def scrub_tokens(spark, d):
    c = secret_docs(spark, d).withColumn("c", R.scrub_tokens("text"))
    return c.select("doc_id", F.md5("c").alias("clean"), (F.col("c") != F.col("text")).alias("changed"))


@query("scrub_cards", S.with_views(SECRET_DOCS, body=f"""SELECT doc_id, md5({scrub_cards_sql('text')}) AS clean,
   {scrub_cards_sql('text')} <> text AS changed FROM sdocs"""))
def scrub_cards(spark, d):
    c = secret_docs(spark, d).withColumn("c", R.scrub_cards("text"))
    return c.select("doc_id", F.md5("c").alias("clean"), (F.col("c") != F.col("text")).alias("changed"))


@query("luhn", f"""SELECT source, count(*) AS n, count(*) FILTER ({IS_CARD}) AS valid FROM (SELECT source,
   unnest({DIGITS.format(x='text')}) AS p FROM documents) WHERE regexp_matches(p, '^[0-9]')
   AND length(regexp_replace(p, '[ -]', '', 'g')) BETWEEN 13 AND 19 GROUP BY source""")
def luhn(spark, d):
    runs = V.documents(spark, d).select("source", F.explode(F.split("text", R.DIGIT_RUN_EDGE)).alias("p"))
    digits = F.regexp_replace("p", "[ -]", "")
    return (runs.filter(F.col("p").rlike(r"\A[0-9]") & F.length(digits).between(13, 19))
            .groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(N.luhn(digits)).alias("valid")))


def wordlist(spark, d):
    """A word list from the benchmark texts: every distinct plain word."""
    b = V.table(spark, d, "benchmark")
    w = b.select(F.explode(T.words("text")).alias("word"))
    return w.filter(F.col("word").rlike(r"\A[A-Za-z]+\z")).select(F.lower("word").alias("word")).distinct()


WORDS = ("wordlist", f"""SELECT DISTINCT lower(w) AS word FROM (SELECT unnest({S.words('text')}) AS w FROM benchmark)
   WHERE regexp_full_match(w, '[A-Za-z]+')""")
TOKS = ("toks", f"""SELECT doc_id, line, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (
   SELECT doc_id, line, {S.words('body')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
     generate_subscripts(string_split(text, chr(10)), 1) AS line FROM sdocs))""")
ISLANDS = ("islands", """SELECT *, count(*) OVER (PARTITION BY doc_id, line, isl, hit) AS len FROM (
   SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line, hit ORDER BY pos) AS isl FROM (
     SELECT t.*, w.word IS NOT NULL AS hit FROM toks t LEFT JOIN wordlist w
       ON regexp_full_match(t.tok, '[A-Za-z]+') AND lower(t.tok) = w.word))""")
RUNS = ("runs", """SELECT doc_id, line - 1 AS line, min(pos) - 1 AS start, count(*) AS length FROM islands
   WHERE hit AND len >= 12 GROUP BY doc_id, line, isl""")
SEED_CLEAN = ("seedclean", f"""SELECT d.doc_id, d.source, d.lang, coalesce(c.text, d.text) AS text FROM sdocs d LEFT JOIN (
   SELECT doc_id, string_agg(CASE WHEN r.body IS NULL THEN l.body ELSE r.body END, chr(10) ORDER BY l.line) AS text FROM (
     SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
       generate_subscripts(string_split(text, chr(10)), 1) AS line FROM sdocs) l
   LEFT JOIN (SELECT doc_id, line, string_agg(CASE WHEN hit AND len >= 12 THEN '{rules.SEED_MARK}' ELSE tok END, ' ' ORDER BY pos) AS body
     FROM (SELECT * FROM islands QUALIFY NOT (hit AND len >= 12) OR row_number() OVER (PARTITION BY doc_id, line, isl, hit ORDER BY pos) = 1)
     GROUP BY doc_id, line HAVING bool_or(hit AND len >= 12)) r USING (doc_id, line) GROUP BY doc_id) c USING (doc_id)""")


def seed_views(source, key):
    """View `seeded`: the keys of `source` whose text holds a run of seed words."""
    return [("ktoks", TOKS[1].replace("sdocs", source).replace("doc_id", key)),
            ("kislands", ISLANDS[1].replace("toks", "ktoks").replace("doc_id", key)),
            ("seeded", f"SELECT DISTINCT {key} FROM kislands WHERE hit AND len >= 12")]


@query("seed_runs", S.with_views(SECRET_DOCS, WORDS, TOKS, ISLANDS, RUNS, body="SELECT doc_id, line, start, length FROM runs"))
def seed_runs(spark, d):
    return X.seed_runs(secret_docs(spark, d), wordlist(spark, d), "doc_id").select(
        "doc_id", F.col("line").cast("bigint").alias("line"), F.col("start").cast("bigint").alias("start"), "length")


@query("scrub_seed_phrases", S.with_views(SECRET_DOCS, WORDS, TOKS, ISLANDS, SEED_CLEAN, body="""
   SELECT doc_id, md5(text) AS clean FROM seedclean"""))
def scrub_seed_phrases(spark, d):
    return X.scrub_seed_phrases(secret_docs(spark, d), wordlist(spark, d), "doc_id").select(
        "doc_id", F.md5("text").alias("clean"))


SCRUBBED = f"{scrub_cards_sql('(' + scrub_tokens_sql('text') + ')')}"


@query("scrub", S.with_views(SECRET_DOCS, WORDS, TOKS, ISLANDS, SEED_CLEAN, ("a", f"""SELECT doc_id,
   {scrub_tokens_sql('text')} AS text FROM seedclean"""), body=f"""
   SELECT doc_id, md5({scrub_cards_sql('text')}) AS clean FROM a"""))
def scrub(spark, d):
    return X.scrub(secret_docs(spark, d), wordlist(spark, d), "doc_id").select(
        "doc_id", F.md5("text").alias("clean"))


@query("contains_secret", S.with_views(SECRET_DOCS, WORDS, TOKS, ISLANDS, SEED_CLEAN, ("a", f"""SELECT s.source, d.text AS raw,
   {scrub_tokens_sql('s.text')} AS t1 FROM seedclean s JOIN sdocs d USING (doc_id)"""), body=f"""
   SELECT source, count(*) AS n, count(*) FILTER ({scrub_cards_sql('t1')} <> raw) AS secret FROM a GROUP BY source"""))
def contains_secret(spark, d):
    docs = X.contains_secret(secret_docs(spark, d), wordlist(spark, d), "doc_id")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("secret").alias("secret"))


@query("secret_summary", S.with_views(SECRET_DOCS, WORDS, TOKS, ISLANDS, RUNS, ("per", f"""SELECT doc_id, source, lang,
   len(list_filter({TOKENS.format(x='text')}, lambda p: {IS_TOKEN})) AS keys,
   len(list_filter({DIGITS.format(x='text')}, lambda p: {IS_CARD})) AS cards,
   (SELECT count(*) FROM runs r WHERE r.doc_id = s.doc_id) AS seeds FROM sdocs s"""), body="""
   SELECT source, lang, count(*) AS texts, sum(seeds)::BIGINT AS seeds, sum(keys)::BIGINT AS keys,
   sum(cards)::BIGINT AS cards, count(*) FILTER (seeds > 0 OR keys > 0 OR cards > 0) AS texts_with_secret
   FROM per GROUP BY source, lang"""))
def secret_summary(spark, d):
    return X.secret_summary(secret_docs(spark, d), wordlist(spark, d), "doc_id", ["source", "lang"])


def windows(spark, d):
    """Window titles and apps built from documents and events."""
    m = V.memory(spark, d)
    pick = F.col("seq") % 6
    app = F.when(pick == 0, "Telegram").when(pick == 1, "Slack").otherwise(F.col("app_name"))
    title = (F.when(pick == 0, F.lit("Chat")).when(pick == 1, F.lit("URGENT merge"))
             .when(pick == 2, F.lit("MetaMask wallet")).when(pick == 3, F.lit("My Bank - login"))
             .otherwise(F.col("window_title")))
    return m.select("stream", app.alias("app"), title.alias("title"))


WINDOWS = ("windows", """SELECT stream, CASE seq % 6 WHEN 0 THEN 'Telegram' WHEN 1 THEN 'Slack' ELSE app_name END AS app,
   CASE seq % 6 WHEN 0 THEN 'Chat' WHEN 1 THEN 'URGENT merge' WHEN 2 THEN 'MetaMask wallet'
     WHEN 3 THEN 'My Bank - login' ELSE window_title END AS title FROM l0""")


def count_kept(rows, drop):
    return rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(~drop).alias("kept"))


def kept_sql(drop):
    return S.with_views("l0", WINDOWS, body=f"SELECT stream, count(*) AS n, count(*) FILTER (NOT {drop}) AS kept FROM windows GROUP BY stream")


@query("private_window_filter", kept_sql("(" + S.has_any("lower(title)", rules.PRIVATE_WINDOW_MARKERS) + " OR "
                                         + S.has_any("lower(app)", rules.PRIVATE_WINDOW_MARKERS) + ")"))
def private_window_filter(spark, d):
    return count_kept(windows(spark, d), R.is_private_window("title", "app"))


@query("title_blacklist_filter", kept_sql(S.has_any("lower(title)", rules.TITLE_BLACKLIST)))
def title_blacklist_filter(spark, d):
    return count_kept(windows(spark, d), R.is_blacklisted_title("title"))


@query("messenger_noise_filter", kept_sql("(" + S.has_any("lower(app)", rules.MESSENGER_APPS) + " AND NOT "
                                          + S.has_any("lower(title)", rules.WORK_TITLE_WORDS) + ")"))
def messenger_noise_filter(spark, d):
    return count_kept(windows(spark, d), R.is_messenger_noise("app", "title"))


def clips(spark, d):
    """Clipboard rows; every second one repeats a short text of its stream."""
    m = V.memory(spark, d, text=True).filter(F.col("app_name") == "clipboard")
    return m.withColumn("text", F.when(F.col("seq") % 2 == 0, F.concat(
        F.lit("  copied "), F.col("stream").cast("string"), F.lit(" \n"))).otherwise(F.col("text")))


@query("clipboard_filter", S.with_views("l0t", ("clips", f"""SELECT id, stream, time_start, seq, {S.trim('''CASE WHEN seq % 2 = 0
   THEN '  copied ' || stream || ' ' || chr(10) ELSE text END''')} AS text FROM l0t WHERE app_name = 'clipboard'"""),
   ("fresh", """SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY stream ORDER BY time_start, seq) AS p
     FROM clips WHERE strlen(text) >= 10) WHERE p IS NULL OR p <> text"""),
   WORDS, *seed_views("fresh", "seq"), ("a", f"SELECT *, {scrub_tokens_sql('text')} AS t1 FROM fresh"), body=f"""
   SELECT stream, id, md5(text) AS text FROM a WHERE {scrub_cards_sql('t1')} = text AND seq NOT IN (SELECT seq FROM seeded)"""))
def clipboard_filter(spark, d):
    return X.clipboard_filter(clips(spark, d), wordlist(spark, d)).select("stream", "id", F.md5("text").alias("text"))


@query("seal_open_fields", """SELECT lang, count(*) AS n, count(*) AS opened, count(*) AS sealed, count(*) AS plain_kept,
   count(*) AS wrong_key_blank FROM documents GROUP BY lang""")
def seal_open_fields(spark, d):
    key, other = F.lit("0123456789abcdef0123456789abcdef"), F.lit("fedcba9876543210fedcba9876543210")
    docs = V.documents(spark, d).withColumn("sealed", R.seal("text", key))
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(R.open_sealed("sealed", key) == F.col("text")).alias("opened"),
        F.count_if(F.col("sealed").startswith(rules.SEAL_MARK)).alias("sealed"),
        F.count_if(R.open_sealed("text", key) == F.col("text")).alias("plain_kept"),
        F.count_if(R.open_sealed("sealed", other) == "").alias("wrong_key_blank"))


def log_lines(spark, d):
    """Log lines: one per event, some echo what was searched."""
    m = V.memory(spark, d)
    k = F.col("seq") % 4
    body = (F.when(k == 0, F.concat(F.lit(" search: "), "window_title"))
            .when(k == 1, F.concat(F.lit(" MEDIA_PLAY "), "app_name"))
            .when(k == 2, F.concat(F.lit(" sent ghp_"), F.lpad("id", 30, "0"), F.lit(" ok")))
            .otherwise(F.concat(F.lit(" tick "), "id")))
    return m.select("seq", F.concat(F.date_format("time_start", "HH:mm:ss"), body).alias("line"))


LOG = ("logs", """SELECT seq, strftime(time_start, '%H:%M:%S') || CASE seq % 4 WHEN 0 THEN ' search: ' || window_title
   WHEN 1 THEN ' MEDIA_PLAY ' || app_name WHEN 2 THEN ' sent ghp_' || lpad(id, 30, '0') || ' ok'
   ELSE ' tick ' || id END AS line FROM l0""")
CUT_LOG = "CASE seq % 4 WHEN 0 THEN left(line, 8) || ' search: […]' WHEN 1 THEN left(line, 8) || ' MEDIA_PLAY […]' ELSE line END"
CUT_LOG = CUT_LOG.replace("' search: […]'", "' search: […]'")


@query("log_line_redact", S.with_views("l0", LOG, body=f"SELECT {CUT_LOG} AS line FROM logs"))
def log_line_redact(spark, d):
    return log_lines(spark, d).select(R.redact_log_line("line").alias("line"))


@query("log_tail_redacted", S.with_views("l0", LOG, body=f"""SELECT seq, CASE WHEN seq % 4 = 2
   THEN left(line, 8) || ' sent [key redacted] ok' ELSE {CUT_LOG} END AS line FROM logs ORDER BY seq DESC LIMIT 200"""))
def log_tail_redacted(spark, d):
    return X.log_tail_redacted(log_lines(spark, d), 200, wordlist(spark, d))
