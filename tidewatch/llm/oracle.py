"""SQL of the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from tidewatch.llm.license_scan import KNOWN, SPELLINGS

_WORD = r"[^\x20\x09-\x0D]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(col: str) -> str:
    t = (f"translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz')")
    t = (f"regexp_replace({t}, '(?m)^[^a-z0-9\\n]*(?:\\(c\\)|©|copyright (?:\\(c\\)|©|[0-9]))"
         "[^\\n]*$', '', 'g')")
    for old, new in SPELLINGS:
        t = f"replace({t}, {_text(old)}, {_text(new)})"
    return (f"trim(regexp_replace({t}, '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', "
            "'g'))")


def _one_line(form: str) -> str:
    return f"trim(regexp_replace({form}, ' *\\n[ \\n]*', ' ', 'g'))"


_KNOWN = ", ".join(f"({_text(n)}, {_text(t)})" for n, _, t in KNOWN)

ORACLE = {
    "op1_license_scan": f"""
        WITH known AS (
            SELECT digest, min(licence) AS licence FROM (
                SELECT licence, sha256({_one_line(_canonical('text'))}) AS digest
                FROM (VALUES {_KNOWN}) AS v(licence, text)) GROUP BY digest),
        forms AS (SELECT doc_id, {_canonical('text')} AS form FROM documents),
        whole AS (
            SELECT doc_id, form, {_one_line('form')} AS line FROM forms),
        digests AS (
            SELECT doc_id, form, CASE WHEN line <> '' THEN sha256(line) END AS digest,
                   length(line) AS n_chars FROM whole),
        lines AS (
            SELECT DISTINCT doc_id, sha256(trim(unnest(string_split(form, chr(10))))) AS digest
            FROM forms),
        notices AS (
            SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
            FROM lines JOIN known USING (digest) GROUP BY doc_id)
        SELECT d.doc_id, d.digest, d.n_chars, k.licence, coalesce(n.notices, '') AS notices
        FROM digests d LEFT JOIN known k USING (digest) LEFT JOIN notices n ON n.doc_id = d.doc_id
    """,
    "op9_rule_ledger": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
                   list_filter(string_split(text, chr(10)),
                               lambda x: regexp_matches(x, '{_WORD}')) AS l
            FROM docs),
        grams AS (
            SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
        twice AS (
            SELECT doc_id, i FROM (
                SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams)
            WHERE n > 1),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (
                SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
        measured AS (
            SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                   coalesce(c.n, 0) AS n_repeat_words,
                   length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
                   length(text) - length(replace(text, '!', '')) AS n_exclamations
            FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id),
        judged AS (
            SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1,
                   100 * n_symbols > 10 * n_words AS r2, 100 * n_dup_lines > 30 * n_lines AS r3,
                   word_chars < 2 * n_words OR word_chars > 14 * n_words AS r4,
                   100 * n_capitals > 40 * word_chars AS r5,
                   100 * n_exclamations > 25 * n_words AS r6
            FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               r0 OR r1 AS base_failed,
               NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept, n_lines, n_capitals,
               n_exclamations,
               r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT
               + 64 * r6::INT AS failed_rules
        FROM judged
    """,
    "op11_phrase_collocations": r"""
        WITH pieces AS (
            SELECT row_number() OVER () AS piece, lang, p FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
                FROM documents)),
        words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (
            SELECT lang, k, i, w FROM (
                SELECT lang, w, unnest([1, 2, 3]) AS k FROM words),
                LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
        f AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
            FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
        cuts AS (
            SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS p1,
                   array_to_string(w[j + 1:], ' ') AS p2
            FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
        scored AS (
            SELECT c.*, x.a AS l, y.a AS r,
                   (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1
            JOIN f y ON y.lang = c.lang AND y.phrase = c.p2),
        best AS (
            SELECT * FROM scored
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        cover AS (
            SELECT lang, phrase, max(a) AS cover FROM (
                SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE k = 3
                UNION ALL
                SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM cand WHERE k = 3)
            GROUP BY ALL),
        kept AS (
            SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
                   AS rank
            FROM best b LEFT JOIN cover c USING (lang, phrase)
            WHERE c.cover IS NULL OR 100 * c.cover < 50 * b.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
        WHERE rank <= 2000
    """,
}
