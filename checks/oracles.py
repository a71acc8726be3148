"""DuckDB SQL for the registered queries, over the same whole tables.

Written from the operators' definitions, with joins and recursive queries where the library
uses array expressions or Arrow kernels.
"""

from __future__ import annotations

NOISE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
BREAK = (r"(?i)<br\b[^>]*>|</?(?:p|div|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|section|article|main"
         r"|header)(?:\s[^>]*)?>")
SENTENCE = "[^.!?。！？\n]+[.!?。！？]*"
REFUSAL = "申し訳ありませんが、その質問にお答えできる情報がありません。"


def tokens(x):
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+')"


def terms(x):
    return tokens(f"lower({x})")


def n_tokens(x):
    return f"len({tokens(x)})"


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def no_noise(x):
    return f"regexp_replace({x}, '{NOISE}', '', 'g')"


def visible(x):
    x = f"regexp_replace({x}, '{BREAK}', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"),
                         ("&apos;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"),
                         ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    x = rf"regexp_replace({x}, '[ \t\r\f]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g')")


def key(*cols):
    fields = ", ".join(f"coalesce(({c})::varchar, '')" for c in cols)
    return f"('0x' || substr(md5(concat_ws(chr(31), {fields})), 1, 15))::bigint"


def content_hash(*cols):
    fields = ", ".join(f"coalesce('v' || ({c})::varchar, 'n')" for c in cols)
    return f"md5(concat_ws(chr(31), {fields}))"


ARTICLES = rf"""articles AS (
  SELECT url, {visible(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)")} AS title,
         nullif(regexp_extract({no_noise('html')}, '(?is)<article\b[^>]*>(.*?)</article>', 1), '')
           AS body
  FROM pages)"""

HREFS = rf"""hrefs AS (
  SELECT page_url, origin, replace(unnest(regexp_extract_all(h, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)), '&amp;', '&') AS href
  FROM (SELECT url AS page_url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
               {no_noise('html')} AS h FROM pages)),
links AS (
  SELECT page_url, origin || href AS url FROM hrefs
  WHERE starts_with(href, '/') AND NOT starts_with(href, '//') AND NOT contains(href, 'http'))"""


def sections(tag):
    """CTEs ending in sections(url, title, section_no, heading, body), numbered from 0."""
    close = rf"(?is)^(.*?)</{tag}\s*>"
    return rf"""{ARTICLES},
cut AS (
  SELECT url, title, unnest(l) AS piece, generate_subscripts(l, 1) AS i
  FROM (SELECT url, title, string_split_regex(body, '(?i)<{tag}(?:\s[^>]*)?>') AS l
        FROM articles WHERE body IS NOT NULL)),
both_parts AS (
  SELECT url, title, i,
    CASE WHEN i > 1 AND regexp_matches(piece, '{close}')
         THEN {visible(f"regexp_extract(piece, '{close}', 1)")} ELSE '' END AS heading,
    CASE WHEN i > 1 AND regexp_matches(piece, '{close}')
         THEN {visible(f"regexp_replace(piece, '{close}', '')")} ELSE {visible('piece')} END AS body
  FROM cut),
sections AS MATERIALIZED (
  SELECT url, title, heading, body,
         (row_number() OVER (PARTITION BY url ORDER BY i) - 1)::integer AS section_no
  FROM both_parts WHERE heading <> '' OR body <> '')"""


def merged(source, limit, out):
    """Greedy merge of source(k, i, t), i from 1, to out(k, i, t), i from 1."""
    return f"""{out}_sized AS (SELECT k, i, t, {n_tokens('t')} AS n FROM {source}),
{out}_fold AS (
  SELECT k, i, t, (n > {limit})::integer AS g, n FROM {out}_sized WHERE i = 1
  UNION ALL
  SELECT s.k, s.i, s.t, CASE WHEN f.n + s.n <= {limit} THEN f.g ELSE f.g + 1 END,
         CASE WHEN f.n + s.n <= {limit} THEN f.n + s.n ELSE s.n END
  FROM {out}_fold f JOIN {out}_sized s ON s.k = f.k AND s.i = f.i + 1),
{out}_joined AS (
  SELECT k, g, {strip("string_agg(t || chr(10), '' ORDER BY i)")} AS t, min(i) AS first
  FROM {out}_fold GROUP BY k, g),
{out} AS (
  SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY g) AS i, first
  FROM {out}_joined WHERE t <> '')"""


def recursive(source, size, overlap, out):
    """Recursive split of source(k, t) to out(k, lo, t); lo orders the pieces of a key."""
    seps = [r"(?s).*?\n\n|(?s).+\z", r"(?s).*?\n|(?s).+\z", r"(?s).*?[.!?。！？]\s|(?s).+\z",
            r"(?s).*?\s|(?s).+\z", rf"(?s).{{1,{size}}}"]
    levels = [f"{out}_0 AS (SELECT k, []::integer[] AS path, t FROM {source} "
              f"WHERE {n_tokens('t')} > {size})"]
    for n, sep in enumerate(seps, 1):
        levels.append(f"""{out}_{n} AS (
  SELECT k, list_append(path, i::integer) AS path, t FROM (
    SELECT k, path, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
      SELECT k, path, CASE WHEN {n_tokens('t')} <= {size} THEN [t]
                           ELSE regexp_extract_all(t, '{sep}') END AS l FROM {out}_{n - 1})))""")
    return ",\n".join(levels) + f""",
{out}_atoms AS (
  SELECT k, t, {n_tokens('t')} AS n, row_number() OVER (PARTITION BY k ORDER BY path) AS i
  FROM {out}_{len(seps)}),
{out}_run AS (
  SELECT k, i, t, sum(n) OVER (PARTITION BY k ORDER BY i) AS e, n FROM {out}_atoms),
{out}_ends AS (
  SELECT k, list_prepend(0, list(e::bigint ORDER BY i)) AS e, max(i) AS last
  FROM {out}_run GROUP BY k),
{out}_fold AS (
  SELECT k, 1::bigint AS i, 1::bigint AS lo, NULL::bigint AS from_, NULL::bigint AS to_
  FROM {out}_ends
  UNION ALL
  SELECT f.k, f.i + 1,
    CASE WHEN fits THEN f.lo ELSE least(kept + 1, f.i) END,
    CASE WHEN fits THEN NULL ELSE f.lo END, CASE WHEN fits THEN NULL ELSE f.i - 1 END
  FROM (
    SELECT f.*, e.e[f.i + 1] - e.e[f.lo] <= {size} AS fits,
      len(list_filter(e.e, lambda x: e.e[f.i] - x > {overlap} OR e.e[f.i + 1] - x > {size})) AS kept
    FROM {out}_fold f JOIN {out}_ends e ON e.k = f.k WHERE f.i <= e.last) f),
{out}_windows AS (
  SELECT k, from_ AS lo, to_ AS hi FROM {out}_fold WHERE from_ IS NOT NULL
  UNION ALL
  SELECT f.k, f.lo, e.last FROM {out}_fold f JOIN {out}_ends e ON e.k = f.k
  WHERE f.i = e.last + 1),
{out}_cut AS (
  SELECT w.k, w.lo, {strip("string_agg(a.t, '' ORDER BY a.i)")} AS t
  FROM {out}_windows w JOIN {out}_atoms a ON a.k = w.k AND a.i BETWEEN w.lo AND w.hi
  GROUP BY w.k, w.lo, w.hi),
{out} AS (
  SELECT k, lo, t FROM {out}_cut WHERE t <> ''
  UNION ALL
  SELECT k, 1, t FROM {source} WHERE {n_tokens('t')} <= {size} AND t <> '')"""


def first_sentence(x):
    return strip(f"regexp_extract({x}, '{SENTENCE}', 0)")


def with_context(title, i, n, page, content, heading=None):
    headed = f"nullif({first_sentence(heading)}, ''), " if heading else ""
    place = f"concat_ws(' › ', nullif({title}, ''), {headed}'part ' || {i} || ' of ' || {n})"
    return f"concat_ws(': ', {place}, nullif({first_sentence(page)}, '')) || chr(10) || chr(10) || {content}"


DOCUMENT_CHUNKS = f"""texts AS (SELECT doc_id AS k, text AS t FROM documents),
{recursive('texts', 512, 50, 'pieces')},
chunks AS (
  SELECT k AS doc_id, t AS content,
         (row_number() OVER (PARTITION BY k ORDER BY lo))::integer AS chunk_no,
         count(*) OVER (PARTITION BY k) AS n_chunks
  FROM pieces)"""

# --- search

WHOLE_DOCUMENTS = f"""docs AS MATERIALIZED (
  SELECT doc_id AS id, source AS url, text AS content, {terms('text')} AS terms FROM documents)"""

DOCUMENT_PASSAGES = f"""{DOCUMENT_CHUNKS},
passages AS MATERIALIZED (
  SELECT {key('doc_id', 'chunk_no', 'content')} AS id, source AS url, content
  FROM chunks JOIN documents USING (doc_id))"""
PASSAGES = f"""{DOCUMENT_PASSAGES},
docs AS MATERIALIZED (SELECT *, {terms('content')} AS terms FROM passages)"""

POSTINGS = f"""postings AS MATERIALIZED (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY ALL),
size AS (SELECT count(*)::double AS n, avg(len(terms)) AS avg_len FROM docs),
vocab AS MATERIALIZED (
  SELECT term, df, ln(1 + ((SELECT n FROM size) - df + 0.5::double) / (df + 0.5::double)) AS idf
  FROM (SELECT term, count(*)::double AS df FROM postings GROUP BY term))"""

CORPUS = f"{WHOLE_DOCUMENTS},\n{POSTINGS}"


def query_terms(source, text, out):
    """Known distinct terms of source(query_id, text) as out(query_id, term, df, idf)."""
    return f"""{out} AS MATERIALIZED (
  SELECT query_id, term, df, idf
  FROM (SELECT DISTINCT query_id, unnest({terms(text)}) AS term FROM {source}) JOIN vocab USING (term))"""


def bm25(source, text, out):
    """Scores of all matching rows as out_raw(query_id, id, raw)."""
    return f"""{query_terms(source, text, out + '_terms')},
{out}_raw AS (
  SELECT q.query_id, p.id,
    sum(q.idf * p.tf * 2.2::double / (p.tf + 1.2::double * (0.25::double + 0.75::double
      * len(d.terms) / (SELECT avg_len FROM size)))) AS raw
  FROM {out}_terms q JOIN postings p USING (term) JOIN docs d ON d.id = p.id
  GROUP BY q.query_id, p.id)"""


def ranked(source, out, k, score, where="true"):
    return f"""{out} AS MATERIALIZED (
  SELECT * FROM (
    SELECT query_id, id, score,
      (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::integer AS rank
    FROM (SELECT query_id, id, {score} AS score FROM {source}) WHERE {where})
  WHERE rank <= {k})"""


def keyword(source, text, out, k):
    return f"""{bm25(source, text, out)},
{ranked(out + '_raw', out, k, 'round(raw, 4)')}"""


def vectors(source, id_, terms_, out, dim=64):
    """Hashed unit vectors of source as out(id_, v DOUBLE[]) rounded through FLOAT."""
    bucket = f"('0x' || substr(md5(t), 1, 15))::bigint % {dim}"
    return f"""{out}_counts AS (
  SELECT {id_}, b, count(*)::double AS c FROM (
    SELECT {id_}, {bucket} AS b FROM (SELECT {id_}, unnest({terms_}) AS t FROM {source}))
  GROUP BY ALL),
{out}_norms AS (SELECT {id_}, sqrt(sum(c * c)) AS norm FROM {out}_counts GROUP BY ALL),
{out}_long AS (
  SELECT {id_}, b, (c / norm)::float::double AS w FROM {out}_counts JOIN {out}_norms USING ({id_})),
{out}_length AS (SELECT {id_}, sqrt(sum(w * w)) AS len FROM {out}_long GROUP BY ALL),
{out} AS (SELECT {id_}, b, w / len AS w FROM {out}_long JOIN {out}_length USING ({id_}))"""


def cosines(queries, out):
    """out_raw(query_id, id, cos) for queries(query_id, text) against docs."""
    return f"""{vectors(queries, 'query_id', terms('text'), out + '_qv')},
{vectors('docs', 'id', 'terms', out + '_dv')},
{out}_dots AS (
  SELECT q.query_id, d.id, sum(q.w * d.w) AS cos FROM {out}_qv q JOIN {out}_dv d USING (b)
  GROUP BY ALL),
{out}_raw AS (
  SELECT q.query_id, d.id, coalesce(x.cos, 0) AS cos
  FROM {queries} q CROSS JOIN docs d LEFT JOIN {out}_dots x
    ON x.query_id = q.query_id AND x.id = d.id)"""


def linear_hybrid(queries, out, k, threshold):
    """Blend of cosine and BM25 over the best BM25 of the query."""
    return f"""{cosines(queries, out + '_vec')},
{bm25(queries, 'text', out + '_kw')},
{out}_best AS (
  SELECT query_id, max(round(raw, 4)) AS best FROM {out}_kw_raw GROUP BY query_id),
{out}_blend AS (
  SELECT v.query_id, v.id,
    round(0.5::double * (1 + v.cos) / 2 + 0.5::double * coalesce(w.raw / b.best, 0), 4) AS blend
  FROM {out}_vec_raw v LEFT JOIN {out}_kw_raw w ON w.query_id = v.query_id AND w.id = v.id
    LEFT JOIN {out}_best b ON b.query_id = v.query_id),
{ranked(out + '_blend', out, k, 'blend', f'score >= {threshold}::double')}"""


BENCHMARK = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
USER_TURNS = f"asked AS (SELECT {key('conv_id', 'turn')} AS query_id, text FROM conversations WHERE role = 'user')"
EVAL_PAIRS = """pairs AS MATERIALIZED (
  SELECT q.conv_id || ':' || q.turn AS request_id, q.conv_id, q.text AS request,
         a.text AS expected_response
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""


def embedded_pairs(score, where="true", label=""):
    return f"""pairs AS MATERIALIZED (
  SELECT q.vec_id AS query_id, d.vec_id AS id, {score} AS s
  FROM (SELECT vec_id, embedding::double[] AS v FROM embeddings) q,
       (SELECT vec_id, embedding::double[] AS v FROM embeddings {label}) d),
{ranked('pairs', 'hits', 20, 's', where)}"""


COS = "round(list_cosine_similarity(q.v, d.v), 6)"
COS01 = "round((1 + list_cosine_similarity(q.v, d.v)) / 2, 6)"


def lsh(bands, bits, dim):
    seed = "(band * 7919 + bit * 104729 + axis * 1299709 + 15485863) % 4294967291"
    return f"""planes AS (
  SELECT band, bit, axis, CASE WHEN ((x * 69621 + 7) % 2147483647) // 65536 % 2 = 1
                               THEN 1::double ELSE -1::double END AS sign
  FROM (SELECT band, bit, axis, ({seed} * 48271 + 11) % 2147483647 AS x
        FROM (SELECT unnest(range({bands}))::bigint AS band),
             (SELECT unnest(range({bits}))::bigint AS bit),
             (SELECT unnest(range({dim}))::bigint AS axis))),
long AS (
  SELECT vec_id, unnest(embedding)::double AS x,
         (generate_subscripts(embedding, 1) - 1)::bigint AS axis FROM embeddings),
signs AS (
  SELECT vec_id, band, bit, (round(sum(x * sign), 6) >= 0)::bigint AS s
  FROM long JOIN planes USING (axis) GROUP BY ALL),
buckets AS (SELECT vec_id, band, sum(s << bit) AS bucket FROM signs GROUP BY vec_id, band),
met AS (
  SELECT DISTINCT q.vec_id AS query_id, d.vec_id AS id
  FROM buckets q JOIN buckets d USING (band, bucket)),
pairs AS MATERIALIZED (
  SELECT query_id, id, round((1 + list_cosine_similarity(
    q.embedding::double[], d.embedding::double[])) / 2, 6) AS s
  FROM met JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = id),
{ranked('pairs', 'hits', 20, 's')}"""


# --- questions and answers

def routed(source, out):
    return f"""{query_terms(source, 'text', out + '_known')},
{out}_asked AS (
  SELECT query_id, count(*) AS n
  FROM (SELECT DISTINCT query_id, unnest({terms('text')}) AS term FROM {source}) GROUP BY query_id),
{out}_share AS (SELECT query_id, count(*) AS n FROM {out}_known GROUP BY query_id),
{out} AS (
  SELECT q.query_id, q.text,
    CASE WHEN coalesce(s.n / a.n, 0) < 0.5 THEN 'general' ELSE 'specific' END AS route
  FROM {source} q LEFT JOIN {out}_asked a ON a.query_id = q.query_id
    LEFT JOIN {out}_share s ON s.query_id = q.query_id)"""


def variants(source, known, out):
    return f"""{out}_words AS (
  SELECT query_id, list_aggregate(list(term ORDER BY df, term)[:5], 'string_agg', ' ') AS rarest
  FROM {known} GROUP BY query_id),
{out}_places AS (
  SELECT query_id, term, min(i) AS i FROM (
    SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) AS i
    FROM (SELECT query_id, {terms('text')} AS l FROM {source})) GROUP BY ALL),
{out}_content AS (
  SELECT query_id, string_agg(term, ' ' ORDER BY i) AS content
  FROM {out}_places JOIN {known} USING (query_id, term)
  WHERE df * 2 <= (SELECT n FROM size) GROUP BY query_id),
{out}_lists AS (
  SELECT q.query_id, list_prepend(q.text, string_split(
    lower(q.text) || ',' || coalesce(c.content, '') || ',' || coalesce(w.rarest, ''), ',')) AS l
  FROM {source} q LEFT JOIN {out}_words w ON w.query_id = q.query_id
    LEFT JOIN {out}_content c ON c.query_id = q.query_id),
{out} AS (
  SELECT query_id, variant_no, variant FROM (
    SELECT query_id, (generate_subscripts(l, 1) - 1)::integer AS variant_no, unnest(l) AS variant
    FROM {out}_lists) WHERE variant <> '')"""


def hyde(source, first, out):
    return f"""{out}_tf AS (
  SELECT h.query_id, p.term, sum(p.tf) AS tf
  FROM {first} h JOIN postings p USING (id) WHERE h.rank <= 3 GROUP BY ALL),
{out}_ranked AS (
  SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS r
  FROM (SELECT query_id, term, round(tf * idf, 6) AS w FROM {out}_tf JOIN vocab USING (term))),
{out}_words AS (
  SELECT query_id, string_agg(term, ' ' ORDER BY r) AS words FROM {out}_ranked WHERE r <= 10
  GROUP BY query_id),
{out} AS (
  SELECT q.query_id, concat_ws(' ', q.text, w.words) AS hyde
  FROM {source} q LEFT JOIN {out}_words w ON w.query_id = q.query_id)"""


def bigrams(x):
    return f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"


def merged_hits(source, out):
    """Dedup of source(query_id, source, variant_no, rank, id, url, content, score)."""
    return f"""{out} AS MATERIALIZED (
  SELECT query_id, content, place, d.id, d.url, d.score FROM (
    SELECT query_id, content, min([source, variant_no, rank]::bigint[]) AS place,
      arg_max({{id: id, url: url, score: score}}, [source, variant_no, rank]::bigint[]) AS d
    FROM {source} GROUP BY query_id, content))"""


def reranked(questions, candidates, out):
    """Five best of candidates(query_id, id, url, content, score) for questions(query_id, text)."""
    return f"""{query_terms(questions, 'text', out + '_known')},
{out}_total AS (SELECT query_id, sum(idf) AS total FROM {out}_known GROUP BY query_id),
{out}_hit AS (
  SELECT c.query_id, c.id, sum(t.idf) AS hit
  FROM {candidates} c JOIN {out}_known t USING (query_id) JOIN postings p
    ON p.id = c.id AND p.term = t.term GROUP BY ALL),
{out}_bigrams AS (
  SELECT query_id, {bigrams('t')} AS asked FROM (
    SELECT query_id, {terms('text')} AS t FROM {questions})),
{out}_scored AS (
  SELECT c.*, round(0.8::double * coalesce(h.hit / t.total, 0) + 0.2::double
    * CASE WHEN len(b.asked) > 0
           THEN len(list_intersect(b.asked, {bigrams('d.terms')})) / len(b.asked) ELSE 0 END, 6)
    AS relevance_score
  FROM {candidates} c JOIN docs d ON d.id = c.id
    LEFT JOIN {out}_hit h ON h.query_id = c.query_id AND h.id = c.id
    LEFT JOIN {out}_total t ON t.query_id = c.query_id
    JOIN {out}_bigrams b ON b.query_id = c.query_id),
{out} AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, id))::integer
      AS rank FROM {out}_scored) WHERE rank <= 5)"""


RAG = ("'System: Answer the question from the reference passages alone, briefly and kindly. "
       f"If they do not hold the answer, reply: {REFUSAL}' || chr(10) || 'Human: 【参考情報】' "
       "|| chr(10) || context || chr(10) || chr(10) || '【質問】' || chr(10) || text")
PLAIN = "'System: Answer the user''s question.' || chr(10) || 'Human: 【質問】' || chr(10) || text"


def prompts(questions, hits, out):
    return f"""{out}_context AS (
  SELECT query_id, string_agg(chr(10) || 'Passage: ' || content || chr(10), '' ORDER BY rank)
    AS context FROM {hits} GROUP BY query_id),
{out} AS (
  SELECT query_id, text, route, context,
    CASE WHEN context IS NULL THEN {PLAIN} ELSE {RAG} END AS prompt
  FROM (SELECT q.query_id, q.text, q.route,
          CASE WHEN q.route = 'specific' THEN coalesce(c.context, '') END AS context
        FROM {questions} q LEFT JOIN {out}_context c ON c.query_id = q.query_id))"""


def extracted(known, hits, out):
    """Best sentence per question from hits(query_id, rank, content)."""
    return f"""{out}_parts AS (
  SELECT query_id, rank, generate_subscripts(l, 1) AS no, {strip('unnest(l)')} AS s
  FROM (SELECT query_id, rank, regexp_extract_all(content, '{SENTENCE}') AS l FROM {hits})),
{out}_total AS (SELECT query_id, sum(idf) AS total FROM {known} GROUP BY query_id),
{out}_hit AS (
  SELECT query_id, rank, no, sum(idf) AS hit
  FROM (SELECT DISTINCT query_id, rank, no, unnest({terms('s')}) AS term FROM {out}_parts)
    JOIN {known} USING (query_id, term) GROUP BY ALL),
{out} AS (
  SELECT query_id, s AS answer FROM (
    SELECT p.query_id, p.s, row_number() OVER (PARTITION BY p.query_id ORDER BY
      round(coalesce(h.hit / t.total, 0), 6) DESC, p.rank, p.no) AS r
    FROM {out}_parts p LEFT JOIN {out}_hit h USING (query_id, rank, no)
      LEFT JOIN {out}_total t ON t.query_id = p.query_id WHERE p.s <> '') WHERE r = 1)"""


def answered(source, search, corpus=PASSAGES, question=True, rewrite=True, expand=True,
             rerank=True):
    """The whole chain for source(query_id, text), ending in final(… route, prompt, answer).

    ``search(source, out, k)`` gives the CTEs of one search over source(query_id, text).
    """
    texts, parts = [], []
    if rewrite:
        parts.append(variants("spec", "spec_known", "variants"))
        texts.append("""SELECT query_id AS question_id, 0 AS source, variant_no,
    query_id || '/0/' || variant_no AS query_id, variant AS text FROM variants""")
    elif question:
        texts.append("""SELECT query_id AS question_id, 0 AS source, 0 AS variant_no,
    query_id || '/0/0' AS query_id, text FROM spec""")
    if expand:
        parts += [search("spec", "first_hits", 3), hyde("spec", "first_hits", "expanded")]
        texts.append("""SELECT query_id AS question_id, 1 AS source, 0 AS variant_no,
    query_id || '/1/0' AS query_id, hyde AS text FROM expanded""")
    by_place = """top AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY place, id))::integer AS rank
    FROM merged) WHERE rank <= 5)"""
    return ",\n".join([
        corpus, POSTINGS, routed(source, "routed"),
        "spec AS MATERIALIZED (SELECT query_id, text FROM routed WHERE route = 'specific')",
        query_terms("spec", "text", "spec_known"), *parts,
        f"searches AS MATERIALIZED ({' UNION ALL '.join(texts)})",
        search("searches", "found", 20),
        """candidates AS MATERIALIZED (
  SELECT s.question_id AS query_id, s.source, s.variant_no, f.rank, f.id, d.url, d.content, f.score
  FROM found f JOIN searches s USING (query_id) JOIN docs d ON d.id = f.id)""",
        merged_hits("candidates", "merged"),
        reranked("spec", "merged", "top") if rerank else by_place,
        prompts("routed", "top", "prompted"),
        extracted("spec_known", "top", "best"),
        f"""final AS (
  SELECT p.*, coalesce(b.answer, '{REFUSAL}') AS answer
  FROM prompted p LEFT JOIN best b ON b.query_id = p.query_id)"""])


def keyword_search(source, out, k):
    return keyword(source, "text", out, k)


def hybrid_search(source, out, k):
    return linear_hybrid(source, out, k, 0.7)


def verdicts(source, f1, recall, grounded):
    """SELECT of the judges over source(request_id, expected_response, answer, context)."""
    share = lambda w, p: (f"CASE WHEN len({w}) > 0 THEN len(list_intersect({w}, {p}))"  # noqa: E731
                          f" / len({w}) ELSE 0 END")
    return f"""SELECT request_id, answer, answer_f1, context_recall, grounded_share,
  answer_f1 >= {f1} AS correctness, context_recall >= {recall} AS context_sufficiency,
  grounded_share >= {grounded} AS groundedness,
  answer_f1 >= {f1} AND context_recall >= {recall} AND grounded_share >= {grounded} AS overall
FROM (
  SELECT request_id, answer,
    round(CASE WHEN len(a) + len(e) > 0 THEN 2 * len(list_intersect(a, e)) / (len(a) + len(e))
               ELSE 0 END, 6)::double AS answer_f1,
    round({share('e', 'c')}, 6)::double AS context_recall,
    round({share('a', 'c')}, 6)::double AS grounded_share
  FROM (SELECT request_id, answer, list_distinct({terms("coalesce(answer, '')")}) AS a,
               list_distinct({terms('expected_response')}) AS e,
               list_distinct({terms("coalesce(context, '')")}) AS c FROM {source}))"""


def evaluated(f1, recall, grounded, corpus=PASSAGES, **steps):
    return f"""WITH RECURSIVE {EVAL_PAIRS},
asked AS (SELECT {key('request_id')} AS query_id, request AS text FROM pairs),
{answered('asked', keyword_search, corpus, **steps)},
rows AS (
  SELECT p.request_id, p.expected_response, f.answer, f.context
  FROM pairs p LEFT JOIN final f ON f.query_id = {key('p.request_id')})
{verdicts('rows', f1, recall, grounded)}"""


def page_corpus(context, custom):
    """CTEs ending in corpus(url, chunk_no, content, page_contents) of the given pages.

    ``custom`` is a SELECT of further contents.
    """
    content = with_context("title", "chunk_no", "n", "page_contents", "t", "heading") if context else "t"
    return f"""{sections('p')},
texts_ AS (SELECT url AS k, section_no + 1 AS i, heading || chr(10) || body AS t FROM sections),
{merged('texts_', 256, 'buffers')},
buffer_texts AS (SELECT [k, i::varchar] AS k, t FROM buffers),
{recursive('buffer_texts', 512, 50, 'page_pieces')},
page AS (
  SELECT url, any_value(title) AS title, string_agg(body, '' ORDER BY section_no) AS page_contents
  FROM sections GROUP BY url),
page_chunks AS MATERIALIZED (
  SELECT k[1] AS url, t, (row_number() OVER w)::integer AS chunk_no,
         count(*) OVER (PARTITION BY k[1]) AS n, heading
  FROM (SELECT p.*, s.heading FROM page_pieces p JOIN buffers b ON b.k = p.k[1] AND b.i = p.k[2]::bigint
        JOIN sections s ON s.url = b.k AND s.section_no + 1 = b.first) WHERE {n_tokens('t')} > 20
  WINDOW w AS (PARTITION BY k[1] ORDER BY k[2]::integer, lo)),
corpus AS MATERIALIZED (
  SELECT url, chunk_no, {content} AS content, page_contents
  FROM page_chunks JOIN page USING (url)
  UNION ALL SELECT '', 0, content, '' FROM ({custom}))"""


def rung(i, name, context, custom, **steps):
    corpus = f"""{DOCUMENT_PASSAGES},
{page_corpus(context, 'SELECT DISTINCT content FROM passages' if custom else "SELECT '' AS content WHERE false")},
docs AS MATERIALIZED (
  SELECT {key('url', 'chunk_no', 'content')} AS id, url, content, {terms('content')} AS terms
  FROM corpus)"""
    return (f"SELECT {i}::integer AS ord, '{name}' AS approach, overall FROM "
            f"({evaluated(0.1, 0.25, 0.5, corpus, **steps)})")


PLAIN_STEPS = dict(rewrite=False, expand=False, rerank=False)
LADDER = f"""SELECT ord, approach, requests, accuracy,
  round(accuracy - lag(accuracy) OVER (ORDER BY ord), 4) AS delta
FROM (
  SELECT ord, approach, count(*) AS requests, round(avg(overall::integer) * 100, 4) AS accuracy
  FROM ({" UNION ALL ".join([
      rung(0, "baseline", False, False, **PLAIN_STEPS),
      rung(1, "+ custom data", False, True, **PLAIN_STEPS),
      rung(2, "+ contextual retrieval", True, True, **PLAIN_STEPS),
      rung(3, "+ HyDE", True, True, question=False, rewrite=False, rerank=False),
      rung(4, "+ rerank and multi-query", True, True)])})
  GROUP BY ord, approach)"""

RANKED = f"""{CORPUS}, {BENCHMARK},
{keyword('asked', 'text', 'found', 20)},
candidates AS MATERIALIZED (
  SELECT f.query_id, 0 AS source, 0 AS variant_no, f.rank, f.id, d.url, d.content, f.score
  FROM found f JOIN docs d ON d.id = f.id),
{merged_hits('candidates', 'merged')},
{reranked('asked', 'merged', 'top')}"""

CLEAN = f"""squeezed AS (
  SELECT doc_id, source, regexp_replace(text, '\\s+', ' ', 'g') AS content FROM documents),
clean AS (
  SELECT min(doc_id) AS id, arg_min(source, doc_id) AS url, content FROM squeezed GROUP BY content
  UNION ALL SELECT {key('text')}, '', text FROM benchmark),
raw AS (SELECT doc_id AS id, source AS url, text AS content FROM documents),
clean_hash AS (SELECT id, {content_hash('url', 'content')} AS h FROM clean),
raw_hash AS (SELECT id, {content_hash('url', 'content')} AS h FROM raw),
diff AS (
  SELECT id, CASE WHEN r.h IS NULL THEN 'insert' WHEN c.h IS NULL THEN 'delete' ELSE 'update' END AS op
  FROM clean_hash c FULL JOIN raw_hash r USING (id) WHERE c.h IS DISTINCT FROM r.h)"""

ORACLES = {
    "link_frontier": f"WITH {HREFS} SELECT DISTINCT url FROM links",
    "link_blocklist": f"""WITH {HREFS} SELECT DISTINCT url FROM links
WHERE NOT ends_with(url, 'pdf')
  AND url NOT IN (SELECT url FROM links WHERE regexp_matches(page_url, 'casino|pills|bets'))""",
    "article_text": f"WITH {ARTICLES} SELECT url, title, {visible('body')} AS text FROM articles",
    "article_rules": f"""WITH {ARTICLES} SELECT p.url, a.title,
  regexp_replace(regexp_extract(p.html, '(?s)<article>.*</article>', 0),
                 '(?s)<h1>.*?</h1>', '', 'g') AS text
FROM pages p JOIN articles a USING (url)""",
    "sections": f"WITH {sections('p')} SELECT url, section_no, heading, body FROM sections",
    "page_text": f"""WITH {sections('h1')}
SELECT url, string_agg(body, '' ORDER BY section_no) AS page_contents FROM sections GROUP BY url""",
    "token_count": f"SELECT doc_id, {n_tokens('text')}::bigint AS n_tokens FROM documents",
    "chunk_filter": f"""SELECT * FROM (
  SELECT doc_id, {n_tokens('text')}::bigint AS n_tokens FROM documents) WHERE n_tokens > 20""",
    "chunk_merge": f"""WITH RECURSIVE lines AS (
  SELECT doc_id AS k, unnest(l) AS t, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
{merged('lines', 256, 'buffers')}
SELECT k AS doc_id, (i - 1)::integer AS chunk_no, t AS content FROM buffers""",
    "chunk_overlap": f"""SELECT doc_id, (s // 462)::integer AS chunk_no,
  array_to_string(t[s + 1:s + 512], ' ') AS content
FROM (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 50, 1), 462)) AS s
      FROM (SELECT doc_id, {tokens('text')} AS t FROM documents))""",
    "chunk_recursive": f"""WITH RECURSIVE {DOCUMENT_CHUNKS}
SELECT doc_id, chunk_no, content FROM chunks""",
    "contextualise": f"""WITH RECURSIVE {DOCUMENT_CHUNKS}
SELECT doc_id, chunk_no, {with_context('d.source', 'chunk_no', 'n_chunks', 'd.text', 'content')} AS content
FROM chunks JOIN documents d USING (doc_id)""",
    "contextualise_model": r"""SELECT doc_id AS id, nullif(m, '') AS context,
  CASE WHEN m = '' THEN 'ValueError: no sentence' END AS error
FROM (SELECT doc_id, regexp_extract(text, '^([^.!?\n]+[.!?])', 1) AS m FROM documents)""",
    "append_custom": """SELECT source AS url, text AS page_contents, text AS content FROM documents
UNION ALL SELECT '', '', text FROM benchmark""",
    "row_key": f"SELECT doc_id, {key('source', 'doc_id', 'text')} AS id FROM documents",
    "build_corpus": f"""WITH RECURSIVE {page_corpus(True, 'SELECT DISTINCT text AS content FROM benchmark')}
SELECT {key('url', 'chunk_no', 'content')} AS id, url, chunk_no, content, page_contents FROM corpus""",
    "stage_report": f"""WITH {HREFS}, {sections('p').split('AS (', 1)[0]}AS ({sections('p').split('AS (', 1)[1]}
SELECT 'links' AS stage, count(*) AS rows, count(DISTINCT url) AS distinct_urls, 0::bigint AS rejected FROM links
UNION ALL SELECT 'frontier', count(DISTINCT url), count(DISTINCT url), 0 FROM links WHERE NOT ends_with(url, 'pdf')
UNION ALL SELECT 'articles', count(*), count(DISTINCT url), count(*) FILTER (body IS NULL) FROM articles
UNION ALL SELECT 'sections', count(*), count(DISTINCT url), 0 FROM sections
UNION ALL SELECT 'documents', count(*), count(DISTINCT source), count(*) FILTER ({n_tokens('text')} <= 20) FROM documents""",
    "hash_embed": f"""WITH d AS (SELECT doc_id, {terms('text')} AS terms FROM documents),
{vectors('d', 'doc_id', 'terms', 'v')}
SELECT doc_id, b::integer AS bucket, round(w, 5) AS weight FROM v_long""",
    "vector_topk": f"WITH {embedded_pairs(COS)} SELECT * FROM hits",
    "vector_topk_block": f"WITH {embedded_pairs(COS)} SELECT * FROM hits",
    "vector_threshold": f"WITH {embedded_pairs(COS01, 'score >= 0.62::double')} SELECT * FROM hits",
    "vector_filter": f"WITH {embedded_pairs(COS01, label='WHERE label = 3')} SELECT * FROM hits",
    "vector_lsh": f"WITH {lsh(16, 8, 64)} SELECT * FROM hits",
    "keyword_topk": f"""WITH {CORPUS}, {BENCHMARK}, {keyword('asked', 'text', 'hits', 20)}
SELECT * FROM hits""",
    "hybrid_topk": f"""WITH {CORPUS}, {BENCHMARK}, {linear_hybrid('asked', 'hits', 20, 0.7)}
SELECT * FROM hits""",
    "hybrid_rrf": f"""WITH {CORPUS}, {BENCHMARK}, {cosines('asked', 'vec')},
{ranked('vec_raw', 'vec', 20, 'round((1 + cos) / 2, 6)')},
{keyword('asked', 'text', 'kw', 20)},
fused AS (
  SELECT query_id, id, sum(1::double / (60 + rank)) AS s
  FROM (SELECT * FROM vec UNION ALL SELECT * FROM kw) GROUP BY ALL),
{ranked('fused', 'hits', 20, 'round(s * 30.5::double, 6)')}
SELECT * FROM hits""",
    "last_question": """SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role,
  arg_max(text, turn) AS question FROM conversations GROUP BY conv_id""",
    "chat_history": """SELECT conv_id, turn, role, text FROM conversations c
WHERE turn < (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)""",
    "route_questions": f"""WITH {CORPUS}, {USER_TURNS}, {routed('asked', 'routed')}
SELECT query_id, route FROM routed""",
    "query_variants": f"""WITH {CORPUS}, {USER_TURNS}, {query_terms('asked', 'text', 'known')},
{variants('asked', 'known', 'variants')} SELECT * FROM variants""",
    "hyde_expand": f"""WITH {CORPUS}, {BENCHMARK}, {keyword('asked', 'text', 'found', 3)},
{hyde('asked', 'found', 'expanded')} SELECT * FROM expanded""",
    "merge_dedup": r"""WITH hits AS (
  SELECT lang AS query_id, text AS content, doc_id AS id, source AS url, n_chars::double AS score,
    CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS s, regexp_extract(source, '(\d+)', 1)::integer AS v,
    n_chars AS r FROM documents)
SELECT query_id, content, arg_max(id, [s, v, r, id]::bigint[]) AS id,
  arg_max(url, [s, v, r, id]::bigint[]) AS url, arg_max(score, [s, v, r, id]::bigint[]) AS score,
  (min([s, v, r]::bigint[])[2])::integer AS first_variant, min([s, v, r]::bigint[])[3] AS first_rank
FROM hits GROUP BY query_id, content""",
    "rerank_top5": f"""WITH {RANKED}
SELECT query_id, rank, id, url, score, relevance_score FROM top""",
    "context_prompt": f"""WITH {RANKED},
routed AS (SELECT *, 'specific' AS route FROM asked), {prompts('routed', 'top', 'prompted')}
SELECT query_id, context, prompt FROM prompted""",
    "extractive_answer": f"""WITH {RANKED}, {extracted('top_known', 'top', 'best')}
SELECT * FROM best""",
    "answer_questions": f"""WITH RECURSIVE {BENCHMARK}, {answered('asked', keyword_search)}
SELECT query_id, text AS question, route, prompt, answer FROM final""",
    "retrieval_log": f"""WITH RECURSIVE {BENCHMARK}, {answered('asked', keyword_search)}
SELECT 'run' AS run_id, query_id, rank, id, url, score, relevance_score FROM top""",
    "custom_csv": "SELECT '' AS url, '' AS page_contents, text AS content FROM benchmark",
    "eval_csv": f"""WITH {EVAL_PAIRS}
SELECT request_id, request, expected_response FROM pairs""",
    "stage_tables": """SELECT 'chunks' AS stage, count(*) AS rows, count(DISTINCT content) AS contents
FROM (SELECT text AS content FROM documents UNION ALL SELECT text FROM benchmark)
UNION ALL SELECT 'chunks_original', count(*), count(DISTINCT text) FROM documents""",
    "eval_set": f"WITH {EVAL_PAIRS} SELECT request_id, request, expected_response FROM pairs",
    "judge_verdicts": f"""WITH {EVAL_PAIRS},
opening AS (SELECT conv_id, arg_min(text, turn) AS context FROM conversations GROUP BY conv_id),
rows AS (
  SELECT request_id, expected_response, request AS answer, context
  FROM pairs JOIN opening USING (conv_id))
SELECT * EXCLUDE (answer) FROM ({verdicts('rows', 0.2, 0.3, 0.4)})""",
    "evaluate_answers": evaluated(0.5, 0.6, 0.8),
    "step_ladder": LADDER,
    "answer_hybrid": f"""WITH RECURSIVE {BENCHMARK}, {answered('asked', hybrid_search)}
SELECT query_id, text AS question, route, prompt, answer FROM final""",
    "accuracy_ladder": """SELECT approach, requests, accuracy,
  round(accuracy - lag(accuracy) OVER (ORDER BY approach), 4) AS delta
FROM (SELECT source AS approach, count(*) AS requests,
        round(avg((quality = 1 AND toxic = 0)::integer) * 100, 4) AS accuracy
      FROM documents JOIN labels USING (doc_id) GROUP BY source)""",
    "answer_leakage": f"""WITH {EVAL_PAIRS},
grams AS (
  SELECT kind, id, request_id, list_distinct(list_transform(
    range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) AS l
  FROM (SELECT 0 AS kind, doc_id AS id, NULL AS request_id, {{d}} AS s FROM documents
        UNION ALL SELECT 1, NULL, request_id, {{e}} FROM pairs)),
asked AS (
  SELECT request_id, unnest(l) AS g, 1::double / len(l) AS w FROM grams WHERE kind = 1),
held AS (SELECT id, unnest(l) AS g FROM grams WHERE kind = 0),
shares AS (
  SELECT request_id AS query_id, id, round(sum(w), 4) AS s
  FROM asked JOIN held USING (g) GROUP BY ALL),
{ranked('shares', 'hits', 1, 's')}
SELECT query_id AS request_id, id, score AS containment FROM hits""".format(
        d=r"regexp_replace(text, '\s+', '', 'g')",
        e=r"regexp_replace(expected_response, '\s+', '', 'g')"),
    "index_diff": f"WITH {CLEAN} SELECT id, op FROM diff",
    "index_sync": f"""WITH {CLEAN}
SELECT id, url, content, {content_hash('url', 'content')} AS content_hash FROM clean""",
    "index_sync_report": f"WITH {CLEAN} SELECT op, count(*) AS rows FROM diff GROUP BY op",
    "index_sync_stream": f"""SELECT {key('text')} AS id, '' AS url, text AS content,
  {content_hash("''", 'text')} AS content_hash FROM (SELECT DISTINCT text FROM documents)""",
    "answer_stream": f"""WITH RECURSIVE {USER_TURNS}, {answered('asked', keyword_search)}
SELECT query_id, text AS question, route, answer FROM final""",
    "frontier_union": f"WITH {HREFS} SELECT DISTINCT url FROM links",
    "link_forms": f"WITH {HREFS} SELECT DISTINCT url FROM links",
    "two_articles": f"""WITH {ARTICLES}
SELECT url, {visible('body')} AS text, {visible('body')} AS by_rule FROM articles""",
    "rejected_pages": "SELECT url FROM pages WHERE page_id % 5 = 0",
    "page_texts": f"""WITH RECURSIVE {DOCUMENT_CHUNKS}
SELECT doc_id, chunk_no, length(text)::bigint AS page_chars, contains(text, content) AS held
FROM chunks JOIN documents USING (doc_id)""",
    "cjk_tokens": r"""SELECT doc_id, (len(regexp_extract_all(t, '[漢字あカン]'))
  + len(regexp_extract_all(regexp_replace(t, '[漢字あカン]', ' ', 'g'), '[\p{L}\p{N}]+')))::bigint AS n_tokens
FROM (SELECT doc_id, translate(text, 'aeiou', '漢字あカン') AS t FROM documents)""",
    "id_conflicts": """SELECT doc_id % 97 AS id, count(*) AS rows, count(DISTINCT text) AS contents
FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "csv_reordered": "SELECT 'u' || item_id AS url, 'p' AS page_contents, text AS content FROM benchmark",
    "csv_rejected": r"""SELECT CASE WHEN item_id % 3 = 0 THEN 'rejected' ELSE 'read' END AS kind,
  CASE WHEN item_id % 3 = 0 THEN ',"' || t || '"' ELSE t END AS content
FROM (SELECT item_id, regexp_replace(text, '[\s"]+', ' ', 'g') AS t FROM benchmark)""",
    "corpus_dead_letters": f"""WITH RECURSIVE {page_corpus(False, "SELECT text AS content FROM benchmark WHERE false")},
sized AS (SELECT url, chunk_no, length(content)::bigint AS n FROM corpus)
SELECT url, chunk_no, CASE WHEN n % 3 = 0 THEN n ELSE n + 3 END AS chars, NULL::varchar AS error FROM sized
UNION ALL SELECT url, chunk_no, n, 'ValueError: refused' FROM sized WHERE n % 3 = 0""",
    "index_dead_letters": """SELECT doc_id AS id, doc_id % 7 <> 0 AS has_vector,
  CASE WHEN doc_id % 7 = 0 THEN 'ValueError: refused' END AS error FROM documents""",
    "sync_then_stream": f"""SELECT {key('text')} AS id, '' AS url, text AS content,
  {content_hash("''", 'text')} AS content_hash FROM (SELECT DISTINCT text FROM documents)""",
}

ORACLES["evaluation_sink"] = f"""WITH leaks AS ({ORACLES['answer_leakage']}), {EVAL_PAIRS},
rows AS (SELECT request_id, expected_response, request AS answer, request AS context FROM pairs)
SELECT 'run' AS run_id, request_id, correctness, context_sufficiency, groundedness, overall,
  leaks.id AS leaked_from, containment
FROM ({verdicts('rows', 0.1, 0.25, 0.5)}) LEFT JOIN leaks USING (request_id)"""

ORACLES["answer_dead_letters"] = """
SELECT item_id AS query_id, 'answered' AS step, CASE WHEN item_id % 4 <> 0 THEN 'yes' END AS answer FROM benchmark
UNION ALL SELECT item_id, 'route', 'ValueError: refused' FROM benchmark WHERE item_id % 5 = 0
UNION ALL SELECT item_id, 'rewrite', 'ValueError: refused' FROM benchmark WHERE item_id % 3 = 0
UNION ALL SELECT item_id, 'hyde', 'ValueError: refused' FROM benchmark WHERE item_id % 7 = 0
UNION ALL SELECT item_id, 'answer', 'ValueError: refused' FROM benchmark WHERE item_id % 4 = 0"""

# The same results by other ways.
for _name, _same in (("keyword_postings", "keyword_topk"), ("vector_cells", "vector_topk"),
                     ("index_diff_ranges", "index_diff"), ("index_compact", "index_sync"), ("change_feed", "index_sync")):
    ORACLES[_name] = ORACLES[_same]

ORACLES["change_images"] = f"""WITH {CLEAN}
SELECT 1::bigint AS batch_id, id, CASE op WHEN 'insert' THEN 'insert' ELSE 'update_after' END AS change, url, content
FROM diff JOIN clean USING (id) WHERE op <> 'delete'
UNION ALL
SELECT 1, id, CASE op WHEN 'update' THEN 'update_before' ELSE 'delete' END, source, text
FROM diff JOIN documents ON doc_id = id WHERE op <> 'insert'"""

ORACLES["dense_ids"] = f"""WITH k AS (SELECT doc_id, {content_hash('text')} AS key FROM documents),
a AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0)),
b AS (SELECT key, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY key) - 1 AS id
      FROM (SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM a)))
SELECT doc_id, id FROM k JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) USING (key)"""

ORACLES["dead_letter_queue"] = """
SELECT doc_id AS id, 't' AS tag, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END AS run,
  CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 1 END AS attempts FROM documents"""
