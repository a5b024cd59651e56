"""DuckDB SQL for the Merkle proofs: one table expression for each level."""

from __future__ import annotations

#: Levels of a source's tree and of the tree over sources; enough for 3 ** 13 rows of a source and 3 ** 7 sources.
SOURCE_LEVELS, TOP_LEVELS = 13, 7


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


#: The unsigned CRC-32 of a decimal number: for each character its code, then eight steps by one bit.
CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""


def _tree(name: str, key: str, levels: int) -> list[str]:
    """Tables name0 to name<levels> of nodes ({key}, i, n, h), and name_root ({key}, root)."""
    out = [f"{name}{k + 1} AS (SELECT {key}, i // 3 AS i, (any_value(n) + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY {key}, i // 3)" for k in range(levels)]
    return [*out, f"{name}_root AS (" + " UNION ALL ".join(f"SELECT {key}, h AS root FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")"]


def _fold(paths: str, start: str, nodes: str, key: str, levels: int) -> list[str]:
    """Tables paths0 to paths<levels> of (rid, {key}, i, n, h, proof): one step up for each level."""
    step = """{paths}{up} AS (SELECT p.rid, p.{key}, p.i // 3 AS i, (p.n + 2) // 3 AS n, p.proof || coalesce(string_agg(s.h, '' ORDER BY s.i), '') AS proof,
        CASE WHEN p.n > 1 THEN sha256(coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i), '') || p.h || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i), '')) ELSE p.h END AS h
        FROM {paths}{k} p LEFT JOIN {nodes}{k} s ON p.n > 1 AND s.{key} = p.{key} AND s.i // 3 = p.i // 3 AND s.i <> p.i GROUP BY p.rid, p.{key}, p.i, p.n, p.h, p.proof)"""
    return [f"{paths}0 AS ({start})", *(step.format(paths=paths, nodes=nodes, key=key, k=k, up=k + 1) for k in range(levels))]


def merkle_sql() -> str:
    deleted = "replace(text, chr(10), '')"
    tables = [
        f"d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {CRC32} % 2 = 0 THEN {_leaf(deleted)} END AS altered FROM documents)",
        "o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS src, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid FROM d)",
        "q AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rid) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM o)",
        "a0 AS (SELECT src, i, n, leaf AS h FROM q)",
        *_tree("a", "src", SOURCE_LEVELS),
        "b0 AS (SELECT 0 AS t, src - 1 AS i, count(*) OVER () AS n, root AS h FROM a_root)",
        *_tree("b", "t", TOP_LEVELS),
        *_fold("p", "SELECT rid, src, i, n, coalesce(altered, leaf) AS h, '' AS proof FROM q", "a", "src", SOURCE_LEVELS),
        *_fold("r", f"SELECT p.rid, 0 AS t, p.src - 1 AS i, (SELECT count(*) FROM a_root) AS n, p.h, p.proof FROM p{SOURCE_LEVELS} p", "b", "t", TOP_LEVELS),
    ]
    return "WITH " + ",\n".join(tables) + f"""
        SELECT q.doc_id, q.leaf, a_root.root AS subroot, b_root.root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = b_root.root AS verified
        FROM q JOIN r{TOP_LEVELS} r ON q.rid = r.rid JOIN a_root ON q.src = a_root.src CROSS JOIN b_root"""
