"""DuckDB statements for the registered queries, written independently of them."""

from __future__ import annotations

import string

from postwise.constants import (
    ANSWER_LATENCY_BUCKETS,
    CONTEXT_CHARS_BUCKETS,
    HTTP_LATENCY_BUCKETS,
    KEYWORD_BLACKLIST,
    RELIABLE_ACCOUNTS,
    RELIABLE_DOMAINS,
    STYLE_SIZE,
    THEMES,
)
from postwise.plans.catalog import DOCUMENT_THEMES, GIVEN_CENTERS, GIVEN_INTERCEPT, GIVEN_WEIGHTS, PAGE_DOMAINS
from postwise.plans.given import VECTOR_PARTS

ORACLES: dict[str, str] = {}

PUNCTUATION = string.punctuation.replace("'", "''")
SPACE = r"\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}"


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _label(handle: str, domains=RELIABLE_DOMAINS) -> str:
    listed = "|".join(d.replace(".", r"\.") for d in domains)
    return (
        rf"CASE WHEN regexp_matches(lower({handle}), '(^|\.)({listed})$') "
        "THEN 'reliable' ELSE 'unverified' END"
    )


POSTS = f"""dated AS (
  SELECT d.doc_id, d.n_chars, d.text, d.lang, e.ts, 'post/' || d.doc_id AS uri,
    strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at,
    CASE WHEN d.source IN ('src0', 'src1') THEN 'reuters.com'
         WHEN d.source IN ('src2', 'src3') THEN 'desk.apnews.com'
         WHEN d.source = 'src4' THEN 'fakereuters.com'
         ELSE d.source || '.example.social' END AS username,
    CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 'Misinformation'
         WHEN d.source IN ('src0', 'src1', 'src2', 'src3') THEN 'Reliable'
         WHEN d.doc_id % 3 = 0 THEN 'Discover'
         WHEN d.doc_id % 3 = 1 THEN 'Trending' ELSE 'Hot Topics' END AS category
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
posts AS (SELECT *, username || '_' || created_at AS unique_id, {_label("username")} AS source_label FROM dated)"""


def _normal(text: str) -> str:
    links = f"http[^{SPACE}]+|www[^{SPACE}]+"
    emojis = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
    steps = f"regexp_replace(lower({text}), '{links}', '', 'g')"
    for pattern in (r"@[\p{L}\p{N}_]+", r"#[\p{L}\p{N}_]+", emojis):
        steps = f"regexp_replace({steps}, '{pattern}', '', 'g')"
    steps = f"translate({steps}, '{PUNCTUATION}', '')"
    return _spaced(_ascii(steps))


def _ascii(text: str) -> str:
    return rf"regexp_replace(strip_accents({text}), '[^\x00-\x7F]', '', 'g')"


def _spaced(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\s\x{{b}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'))"


CLEANED = f"""{POSTS},
cleaned AS (SELECT * EXCLUDE (text), text AS raw_text, {_normal("text")} AS normalized_text FROM posts)"""

CLASSIFIED = f"""{POSTS},
classified AS (SELECT *, (n_chars % 997) / 996.0::DOUBLE AS fake_news_prob,
  (n_chars % 997) / 996.0::DOUBLE >= 0.5 AS is_real,
  CASE WHEN (n_chars % 997) / 996.0::DOUBLE >= 0.5 THEN 'Real' ELSE 'Fake' END AS label FROM posts)"""

EMOTIONS = f"""{POSTS},
emotions AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'anger' WHEN 1 THEN 'disgust' WHEN 2 THEN 'fear'
    WHEN 3 THEN 'joy' WHEN 4 THEN 'neutral' WHEN 5 THEN 'sadness' ELSE 'surprise' END AS emotion,
  (n_chars % 1000)::DOUBLE / 1000 AS emotion_score FROM posts)"""

ENERGY = """logs AS (
  SELECT CASE event_type WHEN 'view' THEN 'ingest' WHEN 'click' THEN 'clean' WHEN 'purchase' THEN 'classify'
      WHEN 'signup' THEN 'emotion' ELSE 'default' END AS pipeline_name,
    event_type || '_node_' || (user_id % 3) AS node_name, 'run_' || (event_id % 97) AS run_id,
    ts AS timestamp, value AS duration_s,
    value * 0.000001::DOUBLE * 1000 AS energy_wh, value * 0.0000006::DOUBLE * 1000 AS cpu_energy_wh,
    value * 0.0000001::DOUBLE * 1000 AS gpu_energy_wh, value * 0.0000003::DOUBLE * 1000 AS ram_energy_wh,
    value * 0.00000005::DOUBLE * 1000000 AS co2_mg
  FROM events)"""

REQUESTS = """log AS (
  SELECT ts, '/ask' AS handler, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
    value / 10 AS latency_s,
    CASE WHEN event_type = 'signup' THEN 'general_knowledge' WHEN event_type = 'error' THEN 'error'
         ELSE 'rag' END AS retrieval_source,
    (user_id % 101)::DOUBLE / 100 AS probability, floor(value * 20) AS context_chars,
    CASE WHEN user_id % 101 >= 60 THEN 'true' WHEN user_id % 101 >= 40 THEN 'very likely true'
         WHEN user_id % 101 >= 20 THEN 'uncertain' WHEN user_id % 101 > 0 THEN 'very likely false'
         ELSE 'false' END AS verdict
  FROM events),
windowed AS (
  SELECT date_trunc('minute', ts) - to_minutes(back) AS start, log.*
  FROM log, (SELECT unnest([0, 1, 2, 3, 4]) AS back))"""


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE}]+'), lambda w: w <> '')"


def _style(table: str, key: str, text: str) -> str:
    return rf"""parts AS (SELECT {key}, {text} AS t, {_words(text)} AS w FROM {table}),
styled AS (SELECT {key}, w, greatest(len(w), 1) AS n,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) / greatest(length(t), 1) AS caps_ratio,
    least((length(t) - length(replace(t, '!', ''))) / greatest(len(w), 1), 1.0) AS exclamation_density,
    least((length(t) - length(replace(t, '?', ''))) / greatest(len(w), 1), 1.0) AS question_density,
    len(list_distinct(w)) / greatest(len(w), 1) AS lexical_diversity,
    least(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1) / 10, 1.0)
      AS avg_word_length FROM parts)"""


STYLE_SELECT = ", ".join(
    f"{c}::DOUBLE AS {c}"
    for c in ("caps_ratio", "exclamation_density", "question_density", "lexical_diversity", "avg_word_length")
)

def _part_counts(text: str) -> list[str]:
    """Counts of the parts of the stand-in vectors, without overlap, plus one."""
    return [f"(1 + (length({text}) - length(replace({text}, '{p}', ''))) // {len(p)})" for p in VECTOR_PARTS]


FEATURES = f"""{CLEANED}, {_style("documents", "doc_id", "text")},
counted AS (SELECT doc_id, [{", ".join(_part_counts("normalized_text"))}]::DOUBLE[] AS n FROM cleaned),
stand_in AS (SELECT doc_id, list_transform(n, lambda v: v / sqrt(list_sum(list_transform(n, lambda u: u * u)))) AS unit
  FROM counted),
vectors AS (SELECT c.*, coalesce(e.label, c.doc_id) AS vector_label,
    list_concat(coalesce(e.embedding::DOUBLE[], v.unit), [s.caps_ratio, s.exclamation_density, s.question_density,
      s.lexical_diversity, s.avg_word_length]::DOUBLE[]) AS x
  FROM cleaned c JOIN stand_in v ON v.doc_id = c.doc_id LEFT JOIN embeddings e ON e.vec_id = c.doc_id
  JOIN styled s ON s.doc_id = c.doc_id),
cells AS (SELECT doc_id, vector_label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM vectors),
centers AS (SELECT vector_label % 2 AS side, i, avg(v) AS m FROM cells GROUP BY ALL),
gaps AS (SELECT doc_id, side, sqrt(sum((v - m) * (v - m))) AS d FROM cells JOIN centers USING (i) GROUP BY ALL),
assigned AS (SELECT doc_id, max(d) FILTER (side = 0) AS d0, max(d) FILTER (side = 1) AS d1,
    CASE WHEN max(d) FILTER (side = 1) < max(d) FILTER (side = 0) THEN 1 ELSE 0 END AS cluster
  FROM gaps GROUP BY doc_id),
rates AS (SELECT cluster, avg((source_label = 'reliable')::INT) - avg((category = 'Misinformation')::INT) AS score
  FROM assigned JOIN posts USING (doc_id) GROUP BY cluster),
oriented AS (SELECT coalesce(max(score) FILTER (cluster = 0), 0.0) AS score_0,
    coalesce(max(score) FILTER (cluster = 1), 0.0) AS score_1 FROM rates),
sides AS (SELECT a.*, CASE WHEN o.score_1 > o.score_0 THEN 0 ELSE 1 END AS fake FROM assigned a, oriented o)"""

LABELLED = f"""{CLEANED},
labelled AS (
  SELECT unique_id, n_chars, 1.0::DOUBLE AS label FROM cleaned WHERE source_label = 'reliable' AND normalized_text <> ''
  UNION ALL
  SELECT unique_id, n_chars, 0.0::DOUBLE FROM cleaned WHERE category = 'Misinformation' AND normalized_text <> '')"""


def _hits(themes: dict[str, list[str]]) -> str:
    rows = ", ".join(
        f"({i}, '{category}', {j}, '{word.lower()}')"
        for i, (category, words) in enumerate(themes.items())
        for j, word in enumerate(words)
    )
    listed = [w for words in THEMES.values() for w in words]
    wanted = [w.lower() for words in themes.values() for w in words]
    beside = r"[^\p{L}\p{N}_]"
    found = " ".join(f"WHEN '{w}' THEN regexp_matches(low, '(^|{beside}){w}($|{beside})')" for w in wanted)
    return f"""{POSTS},
landed AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'search'
    WHEN username IN ({_strings(RELIABLE_ACCOUNTS)}) AND doc_id % 2 = 1 THEN 'account' ELSE '' END AS feed,
  CASE WHEN doc_id % 4 = 0 THEN lower([{_strings(listed)}][(doc_id // 4) % {len(listed)} + 1]) END AS term FROM posts),
keywords(theme_rank, theme, keyword_rank, keyword) AS (VALUES {rows}),
hits AS (
  SELECT p.* EXCLUDE (category), k.*, k.theme AS category
  FROM (SELECT *, lower(text) AS low FROM landed) p, keywords k
  WHERE CASE WHEN p.term IN ({_strings(wanted)}) THEN p.term = k.keyword
    ELSE p.feed <> 'account' AND p.lang = 'en' AND CASE k.keyword {found} END END),
themed AS (SELECT * FROM hits
  QUALIFY row_number() OVER (PARTITION BY uri ORDER BY theme_rank, keyword_rank) = 1),
feed AS (SELECT uri, unique_id, username, 'Reliable' AS category, source_label FROM landed
  WHERE feed = 'account' OR (feed = '' AND username IN ({_strings(RELIABLE_ACCOUNTS)}))),
merged AS (SELECT uri, unique_id, category, source_label FROM (
    SELECT uri, unique_id, category, source_label, 0 AS side FROM feed
    UNION ALL SELECT uri, unique_id, category, source_label, 1 FROM themed)
  QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY side, uri) = 1)"""


TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TFIDF = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT doc_id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
postings AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def _keyword_rows(extra: str = "") -> str:
    return f"""{CLEANED},
words AS (SELECT category, unnest(string_split(normalized_text, ' ')) AS keyword FROM cleaned),
kept AS (SELECT * FROM words WHERE regexp_full_match(keyword, '[A-Za-z]{{3,}}')
  AND keyword NOT IN ({_strings(KEYWORD_BLACKLIST)}))"""


def _top_users(k: int) -> str:
    return f"""WITH {POSTS} SELECT category, username, count(*) AS post_count FROM posts GROUP BY category, username
QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, username) <= {k}"""


START = "strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start"


def _quantile(value: str, bounds: list[float], q: float) -> str:
    """Quantile of one window from ``le`` (bucket bounds) and ``c`` (cumulative counts)."""
    first = len(bounds)
    cases = []
    for i in range(first):
        below, lower = (f"c{i - 1}", bounds[i - 1]) if i else ("0", 0.0)
        if i == 0 and bounds[0] <= 0:
            cases.append(f"WHEN c{i} >= {q} * n THEN {bounds[0]}::DOUBLE")
            continue
        share = f"({q} * n - {below}) / nullif(c{i} - {below}, 0)"
        cases.append(f"WHEN c{i} >= {q} * n THEN {lower}::DOUBLE + ({bounds[i]}::DOUBLE - {lower}::DOUBLE) * {share}")
    return f"round(CASE {' '.join(cases)} ELSE {bounds[-1]}::DOUBLE END, 6)"


def _latency(value: str, bounds: list[float], names: dict[str, float], extra: str = "") -> str:
    counts = ", ".join(f"count(*) FILTER ({value} <= {b}) AS c{i}" for i, b in enumerate(bounds))
    columns = ", ".join(f"{_quantile(value, bounds, q)} AS {name}" for name, q in names.items())
    return f"""WITH {REQUESTS},
buckets AS (SELECT start, count(*) AS n, {counts} FROM windowed GROUP BY start),
found AS (SELECT {START}, {columns} FROM buckets)
SELECT *{extra} FROM found"""


def _band(value: str, first: float, second: float, turned: bool = False) -> str:
    low, high = ("red", "green") if turned else ("green", "red")
    return (
        f"CASE WHEN {value} >= {second} THEN '{high}' WHEN {value} >= {first} THEN 'yellow' "
        f"WHEN {value} IS NOT NULL THEN '{low}' END"
    )


MICROS = "'%Y-%m-%d %H:%M:%S.%f'"
LETTERS = list(zip("aeiouns", ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"], strict=True))
LETTER_SCORES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS place, '{name}' AS emotion, "
    f"1 + length(normalized_text) - length(replace(normalized_text, '{letter}', '')) AS n FROM cleaned"
    for i, (letter, name) in enumerate(LETTERS)
)
RANKED = f"""{CLEANED}, letters AS ({LETTER_SCORES}),
shares AS (SELECT doc_id, place, emotion, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM letters),
ranked AS (SELECT doc_id, emotion, printf('%.4f', share::DOUBLE)::DOUBLE AS score,
  row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, place) - 1 AS position FROM shares)"""

ORACLES["landing_posts"] = f"""WITH {_hits(THEMES)} SELECT uri, username, text, created_at, lang,
  nullif(feed, '') AS feed, CASE feed WHEN 'account' THEN username WHEN 'search' THEN
    [{_strings([w for words in THEMES.values() for w in words])}][(doc_id // 4) % 20 + 1] END AS term,
  ts::DATE AS arrival_date FROM landed"""

ORACLES["quarantined_payloads"] = """SELECT CASE WHEN doc_id % 10 = 3 THEN 'malformed'
    WHEN doc_id % 10 = 7 OR coalesce(text, '') = '' THEN 'incomplete' ELSE 'stored' END AS outcome, count(*) AS n
FROM documents JOIN events ON event_id = doc_id GROUP BY ALL"""

ORACLES["posts_view"] = f"""WITH {CLEANED}
SELECT username, strftime(ts, {MICROS}) AS created_at, category, normalized_text FROM cleaned"""

ORACLES["classified_view"] = f"""WITH {CLASSIFIED}
SELECT username, category, is_real, round(fake_news_prob, 6) AS fake_news_prob,
  strftime(ts, {MICROS}) AS classified_at, label FROM classified"""

ORACLES["emotion_view"] = f"""WITH {EMOTIONS}
SELECT unique_id, username, category, emotion, emotion_score, strftime(ts, {MICROS}) AS classified_at FROM emotions"""

ORACLES["append_posts"] = f"WITH {POSTS} SELECT unique_id, category, true AS has_load_time FROM posts"

ORACLES["upsert_posts"] = f"""WITH {CLASSIFIED}
SELECT c.unique_id, CASE WHEN l.doc_id IS NULL THEN c.category ELSE 'Reviewed' END AS category,
  round(CASE WHEN l.doc_id IS NULL THEN c.fake_news_prob ELSE l.quality::DOUBLE END, 6) AS fake_news_prob
FROM classified c LEFT JOIN labels l USING (doc_id)
UNION ALL
SELECT c.unique_id || '/reply', c.category, round(c.fake_news_prob, 6)
FROM classified c JOIN labels l USING (doc_id) WHERE l.toxic = 1"""

ORACLES["newest_energy_logs"] = f"""WITH {ENERGY}
SELECT run_id, node_name, strftime(timestamp, {MICROS}) AS logged_at, duration_s FROM logs
ORDER BY timestamp DESC, run_id, node_name"""

ORACLES["post_keys"] = f"WITH {POSTS} SELECT doc_id, unique_id FROM posts"

ORACLES["complete_posts"] = """SELECT p.page_id, strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at
FROM pages p JOIN events e ON e.event_id = p.page_id * 50 WHERE p.html <> ''"""

ORACLES["source_labels"] = f"WITH {POSTS} SELECT doc_id, username, source_label FROM posts"

ORACLES["source_labels_by_table"] = ORACLES["source_labels"]

ORACLES["page_source_labels"] = rf"""WITH hosts AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, host, {_label("host", PAGE_DOMAINS)} AS source_label FROM hosts"""

ORACLES["themed_posts"] = f"WITH {_hits(THEMES)} SELECT uri, category, source_label FROM themed"

ORACLES["themed_documents"] = f"""WITH {_hits(DOCUMENT_THEMES)}
SELECT uri, unique_id, category, source_label FROM themed"""

ORACLES["account_feed"] = f"""WITH {_hits(THEMES)}
SELECT uri, unique_id, username, category, source_label FROM feed"""

ORACLES["scorable_posts"] = f"""WITH {CLEANED}
SELECT doc_id, normalized_text FROM cleaned WHERE length(normalized_text) > 0"""

ORACLES["post_defaults"] = f"""WITH {POSTS}
SELECT p.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unverified' ELSE p.source_label END AS source_label, """ + ", ".join(
    f"CASE WHEN l.quality = 1 THEN (p.n_chars * {i + 1})::DOUBLE ELSE 0.0::DOUBLE END AS style_{i}"
    for i in range(STYLE_SIZE)
) + " FROM posts p LEFT JOIN labels l USING (doc_id)"

ORACLES["parsed_instants"] = f"""WITH {POSTS}
SELECT doc_id, strftime(ts - to_hours(CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 0 END), {MICROS}) AS instant FROM posts"""

ORACLES["real_fake_labels"] = f"WITH {CLASSIFIED} SELECT doc_id, is_real, label FROM classified"

ORACLES["energy_units"] = f"""WITH {ENERGY} SELECT strftime(timestamp, {MICROS}) AS logged_at, run_id,
  round(energy_wh, 6) AS energy_wh, round(cpu_energy_wh, 6) AS cpu_energy_wh,
  round(gpu_energy_wh, 6) AS gpu_energy_wh, round(ram_energy_wh, 6) AS ram_energy_wh, round(co2_mg, 6) AS co2_mg
FROM logs"""

ORACLES["emotion_percent"] = f"""WITH {EMOTIONS}
SELECT doc_id, emotion, round_even(emotion_score * 100 * 10, 0)::DOUBLE / 10 AS pct FROM emotions"""

ORACLES["emotion_badges"] = f"""WITH {RANKED}
SELECT doc_id, emotion, upper(emotion[1]) || emotion[2:] || ' ' || round_even(score * 100, 0)::BIGINT || '%' AS badge
FROM ranked WHERE position < 4 AND score > 0.40"""

ORACLES["posts_to_clean"] = f"""WITH {POSTS}
SELECT doc_id, unique_id FROM posts WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""

ORACLES["posts_to_clean_by_keys"] = ORACLES["posts_to_clean"]

ORACLES["posts_to_classify"] = f"""WITH {CLEANED}
SELECT doc_id, unique_id FROM cleaned
WHERE normalized_text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)"""

ORACLES["posts_for_emotion"] = f"""WITH {CLEANED}
SELECT unique_id, username, category, normalized_text FROM cleaned
WHERE normalized_text <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)"""

ORACLES["unseen_posts"] = f"""WITH {_hits(DOCUMENT_THEMES)}
SELECT uri, unique_id, category, source_label FROM merged
WHERE unique_id NOT IN (SELECT p.unique_id FROM posts p JOIN labels l USING (doc_id))"""

ORACLES["aligned_features"] = f"""WITH {FEATURES}
SELECT doc_id, count(*) AS width, round(sum(v), 6) AS total FROM cells GROUP BY doc_id"""

ORACLES["emotion_by_verdict"] = f"""WITH {EMOTIONS}
SELECT CASE WHEN (n_chars % 997) >= 498 THEN 'Real' ELSE 'Fake' END AS label, emotion, count(*) AS count
FROM emotions GROUP BY ALL"""

ORACLES["first_hit_per_uri"] = f"WITH {_hits(DOCUMENT_THEMES)} SELECT uri, category, keyword FROM themed"

ORACLES["first_post_per_author"] = f"""WITH {POSTS}
SELECT username, doc_id FROM posts
QUALIFY row_number() OVER (PARTITION BY username ORDER BY created_at, doc_id) = 1"""

ORACLES["phrase_hits"] = r"""WITH phrases AS (
  SELECT DISTINCT regexp_extract(lower(text), '^[\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+') AS phrase FROM benchmark),
cut AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS t FROM documents),
runs AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS phrase FROM cut)
SELECT DISTINCT doc_id, phrase FROM runs SEMI JOIN phrases USING (phrase)"""

ORACLES["merged_feeds"] = f"WITH {_hits(DOCUMENT_THEMES)} SELECT * FROM merged"

ORACLES["themed_in_one_pass"] = ORACLES["merged_feeds"]

ORACLES["themed_by_tables"] = ORACLES["merged_feeds"]

ORACLES["distinct_keys"] = f"WITH {POSTS} SELECT DISTINCT unique_id FROM posts"

ORACLES["lowercase_text"] = "SELECT doc_id, lower(text) AS result FROM documents"
ORACLES["text_without_urls"] = (
    f"SELECT page_id, regexp_replace(lower(html), 'http[^{SPACE}]+|www[^{SPACE}]+', '', 'g') AS result FROM pages"
)
ORACLES["text_without_mentions"] = (
    r"SELECT doc_id, regexp_replace(text, '@[\p{L}\p{N}_]+', '', 'g') AS result FROM documents"
)
ORACLES["text_without_hashtags"] = (
    r"SELECT page_id, regexp_replace(html, '#[\p{L}\p{N}_]+', '', 'g') AS result FROM pages"
)
ORACLES["text_without_emojis"] = (
    r"SELECT doc_id, regexp_replace(text, "
    r"'[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}]+', '', 'g') AS result FROM documents"
)
ORACLES["text_without_punctuation"] = f"SELECT page_id, translate(html, '{PUNCTUATION}', '') AS result FROM pages"
ORACLES["ascii_text"] = f"SELECT doc_id, {_ascii('text')} AS result FROM documents"
ORACLES["single_spaced_text"] = f"SELECT doc_id, {_spaced(_ascii('text'))} AS result FROM documents"
ORACLES["normalized_posts"] = f"SELECT doc_id, {_normal('text')} AS normalized_text FROM documents"
ORACLES["normalized_pages"] = f"SELECT page_id, {_normal('html')} AS normalized_text FROM pages"
ORACLES["style_features"] = (
    f"WITH {_style('documents', 'doc_id', 'text')} SELECT doc_id, {STYLE_SELECT} FROM styled"
)
ORACLES["page_style_features"] = (
    f"WITH {_style('pages', 'page_id', 'html')} SELECT page_id, {STYLE_SELECT} FROM styled"
)

_BLANK = rf"^[{SPACE}]+|[{SPACE}]+$"
ORACLES["parsed_verdicts"] = rf"""WITH answers AS (
  SELECT conv_id, turn, text AS body, CASE conv_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE 'UNCERTAIN' END AS verdict,
    conv_id % 4 = 3 AS bare FROM conversations WHERE role = 'assistant'),
lines AS (SELECT *, list_filter(string_split_regex(text_of, '\r\n|[\n\r\x{{b}}\x{{c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'),
    lambda l: regexp_replace(l, '{_BLANK}', '', 'g') <> '') AS kept
  FROM (SELECT *, regexp_replace(body, '\x1b\[[0-9;]*m', '', 'g') AS text_of FROM answers))
SELECT conv_id, turn, verdict,
  CASE WHEN bare THEN regexp_replace(text_of, '{_BLANK}', '', 'g')
       ELSE regexp_replace(array_to_string(kept, ' '), '{_BLANK}', '', 'g') END AS reasoning FROM lines"""

M32 = "4294967296"


def _turn(x: str, bits: int) -> str:
    return f"((({x}) << {bits}) % {M32} | (({x}) >> {32 - bits}))"


def _murmur_mix(block: str) -> str:
    return f"({_turn(f'(({block}) * 3432918353) % {M32}', 15)} * 461845907) % {M32}"


def _char(at: str) -> str:
    return f"unicode(w[{at}])::UBIGINT"


# A word falls to the bucket of its 32-bit Murmur3 hash (seed 42, signed, non-negative modulus).
ORACLES["hashed_embeddings"] = f"""WITH {CLEANED},
tokens AS (SELECT doc_id, unnest({_words("normalized_text")}) AS w FROM cleaned),
tf AS (SELECT doc_id, w, count(*) AS n FROM tokens GROUP BY ALL),
blocks AS (SELECT w, length(w) AS len, list_transform(range(length(w) // 4), lambda i:
    {_char("4 * i + 1")} + 256 * {_char("4 * i + 2")} + 65536 * {_char("4 * i + 3")} + 16777216 * {_char("4 * i + 4")}) AS b,
  CASE WHEN length(w) % 4 > 0 THEN {_char("length(w) // 4 * 4 + 1")} ELSE 0 END
    + CASE WHEN length(w) % 4 > 1 THEN 256 * {_char("length(w) // 4 * 4 + 2")} ELSE 0 END
    + CASE WHEN length(w) % 4 > 2 THEN 65536 * {_char("length(w) // 4 * 4 + 3")} ELSE 0 END AS tail
  FROM (SELECT DISTINCT w FROM tf)),
body AS (SELECT w, len, tail, list_reduce(list_prepend(42::UBIGINT, list_transform(b, lambda k: {_murmur_mix("k::UBIGINT")})),
  lambda h, k: ({_turn("xor(h, k)", 13)} * 5 + 3864292196) % {M32}) AS h FROM blocks),
h0 AS (SELECT w, xor(xor(h, CASE WHEN len % 4 > 0 THEN {_murmur_mix("tail::UBIGINT")} ELSE 0 END::UBIGINT), len::UBIGINT) AS h FROM body),
h1 AS (SELECT w, (xor(h, h >> 16) * 2246822507) % {M32} AS h FROM h0),
h2 AS (SELECT w, (xor(h, h >> 13) * 3266489909) % {M32} AS h FROM h1),
h3 AS (SELECT w, xor(h, h >> 16)::BIGINT AS h FROM h2),
spots AS (SELECT w, ((CASE WHEN h >= 2147483648 THEN h - {M32} ELSE h END % 384) + 384) % 384 AS position FROM h3),
cells AS (SELECT doc_id, position, sum(n)::DOUBLE AS v FROM tf JOIN spots USING (w) GROUP BY ALL)
SELECT doc_id, position, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM cells"""

ORACLES["hashed_embedding_norms"] = f"""WITH {CLEANED}
SELECT doc_id, 384::BIGINT AS width, CASE WHEN normalized_text = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM cleaned"""

_COUNTS = [f"(1 + length(normalized_text) - length(replace(normalized_text, '{letter}', '')))" for letter in "aei"]
_LENGTH = "sqrt(" + " + ".join(f"{c} * {c}" for c in _COUNTS) + ")"
ORACLES["encoded_embeddings"] = f"WITH {CLEANED} SELECT doc_id, " + ", ".join(
    f"round({c} / {_LENGTH}, 6) AS e{i}" for i, c in enumerate(_COUNTS)
) + " FROM cleaned"

ORACLES["feature_matrix"] = f"WITH {FEATURES} SELECT doc_id, i - 1 AS position, round(v, 6) AS value FROM cells"

ORACLES["centroid_distances"] = f"""WITH {FEATURES}
SELECT doc_id, round(d0, 6) AS d0, round(d1, 6) AS d1, cluster::BIGINT AS cluster FROM assigned"""

ORACLES["cluster_orientation"] = f"""WITH {FEATURES}
SELECT round(score_0, 6) AS score_0, round(score_1, 6) AS score_1,
  CASE WHEN score_1 > score_0 THEN 1 ELSE 0 END::BIGINT AS real_cluster,
  CASE WHEN score_1 > score_0 THEN 0 ELSE 1 END::BIGINT AS fake_cluster,
  greatest(score_0, score_1) <> 0 AS orientation_known FROM oriented"""

ORACLES["cluster_scores"] = f"""WITH {FEATURES}
SELECT doc_id, round(CASE WHEN fake = 0 THEN d0 ELSE d1 END / (d0 + d1 + 1e-8), 6) AS fake_news_prob,
  cluster <> fake AS is_real FROM sides"""

ORACLES["claim_scores"] = f"""WITH {FEATURES},
margins AS (SELECT doc_id, cluster = fake AS is_fake,
    1 / (1 + exp(-20 * CASE WHEN cluster = fake THEN (d1 - d0) / (d0 + 1e-8) ELSE (d0 - d1) / (d1 + 1e-8) END)) AS confidence
  FROM sides),
scored AS (SELECT doc_id, CASE WHEN is_fake THEN 1 - confidence ELSE confidence END AS score FROM margins),
shown AS (SELECT *, printf('%.4f', score)::DOUBLE AS probability FROM scored)
SELECT doc_id, probability, round_even(score * 100, 0)::BIGINT || '% real' AS verdict,
  round_even(probability * 100, 0)::BIGINT AS score_pct, 'kmeans' AS based_on FROM shown"""

ORACLES["labelled_posts"] = f"WITH {LABELLED} SELECT unique_id, label FROM labelled"

ORACLES["unconflicted_posts"] = f"""WITH {LABELLED}
SELECT unique_id, max(label) AS label FROM labelled GROUP BY unique_id HAVING count(*) = 1"""

ORACLES["sample_counts"] = f"WITH {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label"

ORACLES["balanced_weights"] = f"""WITH {LABELLED}
SELECT unique_id, label, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM labelled"""

ORACLES["softmax_scores"] = """SELECT vec_id,
  printf('%.4f', 1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)))::DOUBLE AS p_real FROM embeddings"""

_RANKS = f"""{LABELLED},
ranks AS (SELECT unique_id, label, count(*) OVER (PARTITION BY label) AS n,
  row_number() OVER (PARTITION BY label ORDER BY md5(unique_id || '42'), unique_id) AS rank FROM labelled)"""

ORACLES["stratified_split"] = f"""WITH {_RANKS}
SELECT unique_id, label, CASE WHEN rank <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM ranks"""

ORACLES["stratified_folds"] = f"WITH {_RANKS} SELECT unique_id, label, (rank - 1) % 5 AS fold FROM ranks"

ORACLES["classifier_evaluation"] = f"""WITH {LABELLED},
scores AS (SELECT label, (n_chars % 997) / 996.0::DOUBLE AS p FROM labelled),
ranked AS (SELECT label, p, avg(place) OVER (PARTITION BY p) AS mean_rank
  FROM (SELECT *, row_number() OVER (ORDER BY p) AS place FROM scores))
SELECT printf('%.4f', (sum(mean_rank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)))::DOUBLE AS roc_auc,
  printf('%.4f', avg(((p >= 0.5)::INT = label)::INT))::DOUBLE AS accuracy FROM ranked"""

ORACLES["top_emotion"] = f"WITH {RANKED} SELECT doc_id, emotion, score AS emotion_score FROM ranked WHERE position = 0"
ORACLES["emotion_ranking"] = f"WITH {RANKED} SELECT doc_id, position AS place, emotion, score FROM ranked"

CLAIMS = """claims AS (SELECT d.doc_id,
    CASE WHEN l.doc_id IS NOT NULL THEN (n_chars % 101) / 100.0::DOUBLE
         WHEN e.vec_id IS NOT NULL THEN (n_chars % 103) / 102.0::DOUBLE
         ELSE (n_chars % 107) / 106.0::DOUBLE END AS p,
    CASE WHEN l.doc_id IS NOT NULL THEN 'xlm_roberta_finetuned' WHEN e.vec_id IS NOT NULL THEN 'reliability_classifier'
         ELSE 'kmeans' END AS based_on
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

ORACLES["scorer_cascade"] = f"WITH {CLAIMS} SELECT doc_id, round(p, 6) AS probability, based_on FROM claims"

def _answer(score: str, p: str) -> str:
    """Columns of an answer from the unrounded score and the shown probability."""
    return f"""round_even({score} * 100, 0)::BIGINT || '% real' AS verdict,
  CASE WHEN {p} >= 0.6 THEN 'true' WHEN {p} >= 0.4 THEN 'very likely true' WHEN {p} >= 0.2 THEN 'uncertain'
       WHEN {p} > 0 THEN 'very likely false' ELSE 'false' END AS label,
  round_even({p} * 100, 0)::BIGINT AS score_pct,
  CASE WHEN {p} >= 0.6 THEN 'success' WHEN {p} >= 0.4 THEN 'warning' ELSE 'danger' END AS band,
  CASE WHEN {p} >= 0.4 THEN 'reliable' ELSE 'potentially misleading' END AS tone"""


ORACLES["answered_claims"] = f"""WITH {CLAIMS}, shown AS (SELECT *, printf('%.4f', p)::DOUBLE AS probability FROM claims)
SELECT doc_id, probability, based_on, {_answer("p", "probability")} FROM shown"""

_GIVEN = f"{GIVEN_WEIGHTS}::DOUBLE[]"
_LINEAR = f"1 / (1 + exp(-(list_dot_product(x, {_GIVEN}) + {GIVEN_INTERCEPT})))"
_GAPS = [f"list_distance(x, {c}::DOUBLE[])" for c in GIVEN_CENTERS]
_TURN_STYLE = _style("turns", "id", "text")
ORACLES["answered_texts"] = f"""WITH turns AS (
  SELECT conv_id * 1000 + turn AS id, conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
{_TURN_STYLE},
counted AS (SELECT id, [{", ".join(_part_counts("text"))}]::DOUBLE[] AS n FROM turns),
vectors AS (SELECT t.*, list_concat(list_transform(c.n, lambda v: v / sqrt(list_sum(list_transform(c.n, lambda u: u * u)))),
    [s.caps_ratio, s.exclamation_density, s.question_density, s.lexical_diversity, s.avg_word_length]::DOUBLE[]) AS x
  FROM turns t JOIN counted c ON c.id = t.id JOIN styled s ON s.id = t.id),
gaps AS (SELECT conv_id, turn, {_LINEAR} AS linear, {_GAPS[0]} AS d0, {_GAPS[1]} AS d1 FROM vectors),
margins AS (SELECT *, 1 / (1 + exp(-20 * CASE WHEN d0 <= d1 THEN (d1 - d0) / (d0 + 1e-8) ELSE (d0 - d1) / (d1 + 1e-8) END))
  AS confidence FROM gaps),
scored AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN linear WHEN d0 <= d1 THEN 1 - confidence ELSE confidence END AS p,
  CASE WHEN conv_id % 2 = 0 THEN 'reliability_classifier' ELSE 'kmeans' END AS based_on FROM margins),
shown AS (SELECT *, printf('%.4f', p)::DOUBLE AS probability FROM scored)
SELECT conv_id, turn, probability, based_on, {_answer("p", "probability")} FROM shown"""

ORACLES["finetuned_answers"] = f"""WITH counted AS (
  SELECT conv_id, turn, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'e', '')) AS e
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')),
shown AS (SELECT conv_id, turn, exp(e - greatest(a, e)) / (exp(a - greatest(a, e)) + exp(e - greatest(a, e))) AS p,
  printf('%.4f', exp(e - greatest(a, e)) / (exp(a - greatest(a, e)) + exp(e - greatest(a, e))))::DOUBLE AS probability FROM counted)
SELECT conv_id, turn, probability, 'xlm_roberta_finetuned' AS based_on, {_answer("p", "probability")} FROM shown"""

ORACLES["verdict_labels"] = f"""WITH {REQUESTS},
asked AS (SELECT ts, CASE WHEN status = 200 THEN probability END AS probability,
  CASE WHEN status = 200 THEN verdict END AS label FROM log)
SELECT strftime(ts, {MICROS}) AS asked_at, probability, label,
  round_even(probability * 100, 0)::BIGINT AS score_pct,
  round_even(probability * 100, 0)::BIGINT || '% real' AS verdict,
  CASE WHEN label IS NULL THEN 'muted' WHEN label = 'true' THEN 'success'
       WHEN label = 'very likely true' THEN 'warning' ELSE 'danger' END AS band,
  CASE WHEN label IN ('true', 'very likely true') THEN 'reliable'
       WHEN label IS NOT NULL THEN 'potentially misleading' END AS tone FROM asked"""

ORACLES["verdict_labels_by_table"] = f"""WITH {REQUESTS}
SELECT strftime(ts, {MICROS}) AS asked_at, CASE WHEN status = 200 THEN verdict END AS label FROM log"""

ORACLES["tfidf_weights"] = f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM postings"

ORACLES["appended_weights"] = ORACLES["tfidf_weights"]

ORACLES["retrieved_documents"] = rf"""WITH {TFIDF},
qtf AS (SELECT item_id, term, count(*) AS tf
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark) GROUP BY ALL),
qraw AS (SELECT item_id, term, tf * idf AS x FROM qtf JOIN idf USING (term)),
q AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS weight FROM qraw),
sims AS (SELECT item_id, doc_id, round(sum(q.weight * p.weight), 10) AS sim
  FROM q JOIN postings p USING (term) GROUP BY ALL)
SELECT item_id AS query_id, doc_id, round(sim, 6) AS similarity,
  row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rank FROM sims WHERE sim > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) <= 5"""

ORACLES["top_users_per_category"] = _top_users(10)
ORACLES["top_eight_authors"] = _top_users(8)

ORACLES["trending_keywords"] = f"""WITH {_keyword_rows()}
SELECT keyword, count(*) AS count FROM kept GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 20"""

ORACLES["trending_keywords_by_category"] = f"""WITH {_keyword_rows()}
SELECT category, keyword, count(*) AS count FROM kept GROUP BY category, keyword
QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, keyword) <= 12"""

ORACLES["posts_per_hour"] = f"WITH {POSTS} SELECT hour(ts) AS hour, count(*) AS count FROM posts GROUP BY ALL"
ORACLES["posts_per_day"] = f"""WITH {POSTS}
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00') AS date, count(*) AS count FROM posts GROUP BY ALL"""
ORACLES["fake_real_distribution"] = f"WITH {CLASSIFIED} SELECT label, count(*) AS count FROM classified GROUP BY label"
ORACLES["classification_by_category"] = f"""WITH {CLASSIFIED}
SELECT category, label, count(*) AS count FROM classified GROUP BY ALL"""
ORACLES["prob_histogram"] = f"""WITH {CLASSIFIED}
SELECT least(greatest(trunc(fake_news_prob * 10), 0), 9) / 10 AS bin_start, count(*) AS count,
  CASE WHEN least(greatest(trunc(fake_news_prob * 10), 0), 9) >= 5 THEN 'real' ELSE 'fake' END AS side
FROM classified GROUP BY ALL"""
ORACLES["classification_tables"] = f"""WITH {CLASSIFIED},
binned AS (SELECT *, least(greatest(trunc(fake_news_prob * 10), 0), 9)::INT AS bin FROM classified)
SELECT 'labels' AS report, label AS key, NULL AS then, count(*) AS n FROM binned GROUP BY label
UNION ALL SELECT 'categories', category, label, count(*) FROM binned GROUP BY category, label
UNION ALL SELECT 'bins', bin::VARCHAR, CASE WHEN bin >= 5 THEN 'real' ELSE 'fake' END, count(*) FROM binned GROUP BY bin
UNION ALL SELECT 'real', NULL, NULL, count(*) FILTER (is_real) FROM binned
UNION ALL SELECT 'fake', NULL, NULL, count(*) FILTER (NOT is_real) FROM binned"""
ORACLES["emotion_distribution"] = f"WITH {EMOTIONS} SELECT emotion, count(*) AS count FROM emotions GROUP BY emotion"
ORACLES["emotion_by_category"] = f"""WITH {EMOTIONS}
SELECT category, emotion, count(*) AS count FROM emotions GROUP BY ALL"""
ORACLES["avg_emotion_score"] = f"""WITH {EMOTIONS}
SELECT emotion, round_even(avg(emotion_score) * 1000, 0)::DOUBLE / 1000 AS avg_score FROM emotions GROUP BY emotion"""

ORACLES["corpus_kpis"] = f"""WITH {_keyword_rows()}
SELECT count(*) AS total_posts, count(DISTINCT username) AS authors, count(*) AS classified,
  round_even(100.0::DOUBLE * count(*) FILTER (n_chars % 997 < 498) / count(*), 0)::BIGINT || '%' AS fake_rate,
  (SELECT keyword FROM kept GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 1) AS top_keyword FROM cleaned"""

ORACLES["classification_kpis"] = f"""WITH {CLASSIFIED}
SELECT count(*) FILTER (is_real) AS n_real, count(*) FILTER (NOT is_real) AS n_fake,
  round(100.0::DOUBLE * count(*) FILTER (is_real) / count(*), 6) AS pct_real,
  round(100.0::DOUBLE * count(*) FILTER (NOT is_real) / count(*), 6) AS pct_fake,
  round(avg(fake_news_prob), 6) AS avg_probability FROM classified"""

ORACLES["categories_by_real_share"] = f"""WITH {CLASSIFIED}
SELECT category, round(nullif(avg(is_real::INT), 0), 6) AS real_share FROM classified GROUP BY category"""

ORACLES["share_within_category"] = f"""WITH {CLASSIFIED}
SELECT category, label, count, round(count / sum(count) OVER (PARTITION BY category), 6)::DOUBLE AS share
FROM (SELECT category, label, count(*) AS count FROM classified GROUP BY category, label)"""

ORACLES["emotion_kpis"] = f"""WITH {EMOTIONS}, counted AS (SELECT emotion, count(*) AS n FROM emotions GROUP BY emotion)
SELECT (SELECT count(*) FROM emotions) AS posts_analysed, upper(emotion[1]) || emotion[2:] AS dominant_emotion
FROM counted ORDER BY n DESC, emotion LIMIT 1"""

ORACLES["categories_in_order"] = f"""WITH {CLASSIFIED}
SELECT category, label, count(*) AS count, CASE category WHEN 'Reliable' THEN 1 WHEN 'Misinformation' THEN 2
  WHEN 'Hot Topics' THEN 3 WHEN 'Discover' THEN 4 WHEN 'Trending' THEN 5 ELSE 6 END::BIGINT AS category_rank
FROM classified GROUP BY ALL"""

ORACLES["energy_by_job"] = f"""WITH {ENERGY}
SELECT pipeline_name, round(sum(energy_wh), 6) AS total_wh, round(sum(co2_mg), 6) AS total_co2_mg,
  count(DISTINCT run_id) AS runs, round(sum(duration_s), 6) AS total_duration_s FROM logs GROUP BY pipeline_name"""

ORACLES["energy_by_node"] = f"""WITH {ENERGY}
SELECT pipeline_name, node_name, round(avg(energy_wh), 6) AS avg_wh, round(sum(energy_wh), 6) AS total_wh,
  round(avg(cpu_energy_wh), 6) AS avg_cpu_wh, round(avg(gpu_energy_wh), 6) AS avg_gpu_wh,
  round(avg(ram_energy_wh), 6) AS avg_ram_wh, round(avg(duration_s), 6) AS avg_duration_s,
  count(run_id) AS runs FROM logs GROUP BY pipeline_name, node_name"""

ORACLES["energy_timeline"] = f"""WITH {ENERGY}
SELECT run_id, pipeline_name, strftime(timestamp, {MICROS}) AS timestamp, round(sum(energy_wh), 6) AS total_wh,
  round(sum(co2_mg), 6) AS total_co2_mg FROM logs GROUP BY run_id, pipeline_name, logs.timestamp"""

ORACLES["energy_kpis"] = f"""WITH {ENERGY}
SELECT round(sum(energy_wh), 6) AS total_wh, round(sum(co2_mg), 6) AS total_co2_mg,
  count(DISTINCT run_id) AS total_runs,
  (SELECT node_name FROM logs GROUP BY pipeline_name, node_name ORDER BY sum(energy_wh) DESC LIMIT 1) AS heaviest_node
FROM logs"""

ORACLES["energy_breakdown"] = " UNION ALL ".join(
    f"(WITH {ENERGY} SELECT node_name, '{name.upper()}' AS component, round(avg({name}_energy_wh), 6) AS avg_wh "
    "FROM logs GROUP BY pipeline_name, node_name)"
    for name in ("cpu", "ram", "gpu")
)

ORACLES["recent_runs"] = f"""WITH {ENERGY}
SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS time, pipeline_name AS pipeline, node_name AS node,
  printf('%.4f', energy_wh) AS energy_wh, printf('%.3f', co2_mg) AS co2_mg, printf('%.2f', duration_s) AS duration_s
FROM logs ORDER BY timestamp DESC, run_id, node_name LIMIT 40"""

ORACLES["total_requests"] = f"WITH {REQUESTS} SELECT count(*) AS requests FROM log WHERE handler LIKE '%/ask%'"

ORACLES["request_rate"] = f"""WITH {REQUESTS}
SELECT {START}, floor(count(*) / 300.0::DOUBLE * 60 * 100 + 0.5) / 100 AS requests_per_minute
FROM windowed GROUP BY start"""

ORACLES["error_rate"] = f"""WITH {REQUESTS},
found AS (SELECT {START}, round(100.0::DOUBLE * count(*) FILTER (status = 500) / count(*), 6) AS error_rate
  FROM windowed GROUP BY start)
SELECT *, {_band("error_rate", 1, 5)} AS band FROM found"""

ORACLES["hit_rate"] = f"""WITH {REQUESTS},
found AS (SELECT round(100.0::DOUBLE * count(*) FILTER (retrieval_source = 'rag') / count(*), 6) AS hit_rate FROM log)
SELECT *, {_band("hit_rate", 40, 70, True)} AS band FROM found"""

ORACLES["http_latency"] = _latency("latency_s", HTTP_LATENCY_BUCKETS, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
ORACLES["answer_latency"] = _latency("latency_s", ANSWER_LATENCY_BUCKETS, {"p50": 0.5, "p95": 0.95})
ORACLES["context_size"] = _latency(
    "context_chars", CONTEXT_CHARS_BUCKETS, {"p50": 0.5, "p95": 0.95},
    f", 300.0::DOUBLE AS target, {_band('p50', 200, 300, True)} AS band",
)

ORACLES["verdict_totals"] = f"WITH {REQUESTS} SELECT verdict, count(*) AS total FROM log GROUP BY verdict"
ORACLES["verdict_rates"] = f"""WITH {REQUESTS}
SELECT {START}, verdict, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM windowed GROUP BY start, verdict"""
ORACLES["retrieval_rates"] = f"""WITH {REQUESTS}
SELECT {START}, retrieval_source, round(count(*) / 300.0::DOUBLE, 6) AS per_second
FROM windowed GROUP BY start, retrieval_source"""

ORACLES["cpu_busy"] = f"""WITH samples AS (
  SELECT user_id % 2 AS host, ts, (epoch_us(ts) % 86400000000) / 1e6 * 0.7::DOUBLE AS idle,
    date_trunc('minute', ts) - to_minutes(back) AS start
  FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS back)),
steps AS (SELECT host, start, row_number() OVER w AS newest, idle, lead(idle) OVER w AS before,
    (epoch_us(ts) - epoch_us(lead(ts) OVER w)) / 1e6 AS seconds FROM samples
  WINDOW w AS (PARTITION BY host, start ORDER BY ts DESC, idle DESC)),
found AS (SELECT {START}, round(100 - 100 * avg(CASE WHEN idle >= before THEN idle - before ELSE idle END / seconds), 6) AS cpu_busy
  FROM steps WHERE newest = 1 AND before IS NOT NULL GROUP BY start)
SELECT *, {_band("cpu_busy", 70, 90)} AS band FROM found"""

ORACLES["memory_and_disk"] = f"""WITH used AS (
  SELECT event_id, round(value * 3e7 / 16e9 * 100, 6) AS ram_used, round(value * 1e9 / 500e9 * 100, 6) AS disk_used FROM events)
SELECT *, {_band("ram_used", 75, 90)} AS ram_band, {_band("disk_used", 75, 90)} AS disk_band FROM used"""

ORACLES["streamed_posts"] = f"""WITH {_hits(DOCUMENT_THEMES)}
SELECT unique_id, p.username, m.category, m.source_label FROM merged m JOIN posts p USING (unique_id)"""

ORACLES["streamed_cleaning"] = f"""WITH {CLEANED}, {_style("documents", "doc_id", "text")}
SELECT unique_id, normalized_text, round(caps_ratio, 6) AS caps_ratio FROM cleaned JOIN styled USING (doc_id)"""

ORACLES["streamed_daily_counts"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00') AS window_start, count(*) AS count FROM events GROUP BY ALL"""

ORACLES["streamed_request_windows"] = f"""WITH {REQUESTS}
SELECT {START}, count(*) AS requests, count(*) FILTER (status = 500) AS errors FROM windowed GROUP BY start"""

ORACLES["streamed_verdict_windows"] = f"""WITH {REQUESTS}
SELECT {START}, verdict, count(*) AS requests, count(*) FILTER (status = 500) AS errors FROM windowed GROUP BY start, verdict"""


# Fitted models, checked by what must hold for any fit.
_EVERY = f"WITH {CLEANED}"
ORACLES["fitted_clusters"] = f"{_EVERY} SELECT doc_id, 0.0::DOUBLE AS gap, 0::BIGINT AS drift FROM cleaned"
ORACLES["reloaded_clusters"] = f"{_EVERY} SELECT doc_id, 0.0::DOUBLE AS difference FROM cleaned"
ORACLES["reloaded_reliability"] = ORACLES["reloaded_clusters"]
ORACLES["reliability_gradient"] = "SELECT unnest(range(70)) AS position, 0::BIGINT AS gradient"
ORACLES["fitted_auc_is_valid"] = "SELECT unnest(range(5)) AS fold, true AS valid"
ORACLES["reliability_scores"] = f"""WITH {FEATURES}
SELECT doc_id, printf('%.4f', {_LINEAR})::DOUBLE AS reliability FROM vectors"""

_AREAS = f"""{_RANKS},
folded AS (SELECT r.label, (r.rank - 1) % 5 AS fold, (l.n_chars % 997) / 996.0::DOUBLE AS p
  FROM ranks r JOIN labelled l ON l.unique_id = r.unique_id AND l.label = r.label),
placed AS (SELECT label, fold, avg(place) OVER (PARTITION BY fold, p) AS mean_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p) AS place FROM folded)),
areas AS (SELECT fold::INT AS fold, (sum(mean_rank) FILTER (label = 1)
      - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS roc_auc FROM placed GROUP BY fold)"""
ORACLES["cross_validated_auc"] = f"WITH {_AREAS} SELECT fold, round(roc_auc, 6) AS roc_auc FROM areas"
ORACLES["cross_validation_summary"] = f"""WITH {_AREAS}
SELECT round(avg(roc_auc), 6) AS mean_auc, round(stddev_pop(roc_auc), 6) AS std_auc FROM areas"""

ORACLES["sample_guards"] = f"""WITH {LABELLED},
found AS (SELECT count(*) FILTER (label = 1) AS reliable, count(*) FILTER (label = 0) AS misinformation FROM labelled),
guards(guard, least) AS (VALUES ('fine-tuning', 30), ('reliability', 1))
SELECT guard, least::BIGINT AS least, reliable, misinformation,
  reliable >= least AND misinformation >= least AS passes FROM guards, found"""
ORACLES["training_set"] = ORACLES["stratified_split"]

ORACLES["staged_classification"] = f"""WITH {_hits(THEMES)},
kept AS (SELECT m.unique_id, m.category, {_normal("p.text")} AS normalized_text FROM merged m JOIN posts p USING (unique_id))
SELECT unique_id, category, true AS in_range FROM kept WHERE normalized_text <> ''"""
