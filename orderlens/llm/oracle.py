"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents
), g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM t JOIN g USING (s)
"""

OP6 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, says,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM m WHERE k = 1
"""


OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
b AS (SELECT r, doc_id, unnest(range(1, octet_length(x) + 1)) AS p, x FROM d),
c AS (SELECT r, doc_id, p, hex(x[p:p]) AS c, x[p:p + 49] AS s FROM b),
m AS (SELECT s, min(doc_id) AS low FROM c WHERE octet_length(s) = 50 GROUP BY s),
k AS (SELECT r, p, c, max(coalesce(low < doc_id, false)) OVER (PARTITION BY r ORDER BY p ROWS 49 PRECEDING) AS gone
      FROM c LEFT JOIN m USING (s)),
g AS (SELECT r, p, c, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS lead FROM k),
t AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (lead) AS n_spans,
             string_agg(c, '' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""

OP11_LEVELS = 8  # 8^8 leaves a group


def op11() -> str:
    """Levels unrolled: every node with its parent's run and the siblings left and right of it."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    def tree(name: str, source: str) -> list[str]:
        out = [f"{name}0 AS ({source})"]
        for k in range(OP11_LEVELS):
            run = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT g, pos, h, n, "
                       f"coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                       f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, "
                       f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, "
                       f"(any_value(n) + 7) // 8 AS n FROM {name}{k} GROUP BY g, pos // 8)")
        return out

    def climb(name: str, start: str) -> list[str]:
        out = []
        for k in range(OP11_LEVELS):
            out.append(f"{start}{k + 1} AS (SELECT c.* REPLACE (c.pos // 8 AS pos, "
                       f"CASE WHEN s.n > 1 THEN c.proof || s.l || s.r ELSE c.proof END AS proof, "
                       f"CASE WHEN s.n > 1 THEN sha256(s.l || c.f || s.r) ELSE c.f END AS f) "
                       f"FROM {start}{k} c JOIN {name}s{k} s ON c.g IS NOT DISTINCT FROM s.g AND c.pos = s.pos)")
        return out

    leaf = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    shown = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "shown"))
    last = OP11_LEVELS
    ctes = [
        # DuckDB has no crc32: eight steps a byte over the id's digits
        "bytes AS (SELECT DISTINCT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UINTEGER) AS b FROM documents)",
        "crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UINTEGER, b), lambda c, x: list_reduce("
        "list_prepend(xor(c, x), [0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER, 0::UINTEGER]), "
        "lambda d, y: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::UINTEGER) ELSE d // 2 END)), 4294967295::UINTEGER) AS crc FROM bytes)",
        "seen AS (SELECT d.*, CASE WHEN coalesce(crc % 3 = 0, false) "
        "THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown "
        "FROM documents d LEFT JOIN crc USING (doc_id))",
        f"leaves AS (SELECT doc_id, lang, sha256({leaf}) AS leaf, sha256({shown}) AS shown_leaf FROM seen)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, "
        "count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
        *tree("a", "SELECT lang AS g, pos, leaf AS h, n FROM placed"),
        "langs AS (SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n "
        f"FROM a{last})",
        *tree("b", "SELECT 0 AS g, pos, h, n FROM langs"),
        "c0 AS (SELECT lang AS g, pos, doc_id, leaf, lang, '' AS proof, shown_leaf AS f FROM placed)",
        *climb("a", "c"),
        f"d0 AS (SELECT c.* REPLACE (0 AS g, l.pos AS pos), l.h AS subroot FROM c{last} c "
        "JOIN langs l ON c.lang IS NOT DISTINCT FROM l.lang)",
        *climb("b", "d"),
    ]
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, "
            f"f = b.h AS verified FROM d{last} d CROSS JOIN b{last} b")


def llm_oracle() -> dict[str, str]:
    return {"op5_exact_dedup": OP5, "op6_url_filter": OP6, "op11_merkle_manifest": op11(), "op12_suffix_array_dedup": OP12}
