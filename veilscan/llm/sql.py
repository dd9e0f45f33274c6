"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = (
    "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_KEY = ASCII_LOWER.format(f"trim(line, {BLANKS})")

OP10_LINES = f"""
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM cut
), keyed AS (
    SELECT doc_id, line, nr, {_KEY} AS key FROM line
), shared AS (
    SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS gone
    FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9_MIX = f"""
WITH doc AS (
    SELECT doc_id, source, {WORDS}::BIGINT AS size,
        ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
    FROM documents
), total AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM doc GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
        WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM total
), running AS (
    SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0) AS words,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
    FROM weighed
    WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
    SELECT *, 3 * source_size * weights < weight * words AS above FROM running
), rest AS (
    SELECT sum(source_size) - 3 * coalesce(sum(source_size) FILTER (above), 0) AS words,
        sum(weight) - coalesce(sum(weight) FILTER (above), 0) AS weights FROM judged
), aimed AS (
    SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE
        least((weight * rest.words)::DOUBLE / rest.weights::DOUBLE, (3 * source_size)::DOUBLE) END AS target
    FROM judged, rest
), planned AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END::BIGINT AS passes
    FROM aimed
), quota AS (
    SELECT *, floor(target - passes * source_size)::BIGINT AS quota FROM planned
), placed AS (
    SELECT source, place, sum(size)::BIGINT AS size FROM doc GROUP BY source, place
), upto AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS run FROM placed
), cut AS (
    SELECT q.source, min(place + CASE WHEN 2 * (quota - (run - size)) >= size THEN 1 ELSE 0 END)
        FILTER (run > quota) AS cut
    FROM upto u JOIN quota q ON u.source IS NOT DISTINCT FROM q.source GROUP BY q.source
)
SELECT doc_id, size, q.source_size, target,
    (size * (passes + CASE WHEN passes < 3 AND place < coalesce(cut, 1152921504606846976) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM doc d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source
JOIN cut c ON d.source IS NOT DISTINCT FROM c.source
"""

_BITS = "('0x' || substr(sha1, {0} * 5 + 1, 5))::INTEGER"
_CHARS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS.format('i')} >> {s}) & 31) + 1, 1)"
    for s in (15, 10, 5, 0)
)
OP8_WARC = f"""
WITH page AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digested AS (
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS sha1,
        min(page_id) OVER (PARTITION BY payload) AS first FROM page
)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(8), lambda i: {_CHARS}), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM digested
"""

OP5_TOP = """
WITH vector AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM vector q JOIN vector c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_DRAW = "('0x' || substr(sha256('1:' || doc_id::VARCHAR), {0}, 8))::BIGINT"
OP11_FIM = f"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
        {_DRAW.format(1)} AS h1, {_DRAW.format(9)} AS h2, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4
    FROM documents
), placed AS (
    SELECT *, len(tokens)::BIGINT AS n,
        least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS first,
        greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS last,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parted AS (
    SELECT doc_id, text, n, form,
        array_to_string(tokens[1:first], '') AS prefix,
        array_to_string(tokens[first + 1:last], '') AS middle,
        array_to_string(tokens[last + 1:], '') AS suffix
    FROM placed
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parted
"""


def statements() -> dict[str, str]:
    return {
        "op5_exact_top_k": OP5_TOP,
        "op8_content_archive": OP8_WARC,
        "op9_weighted_mix": OP9_MIX,
        "op10_line_dedup": OP10_LINES,
        "op11_fill_in_middle": OP11_FIM,
    }
