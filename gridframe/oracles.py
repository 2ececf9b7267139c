"""Generators of DuckDB oracle text for the edit queries.

The oracle models an ordered batch relationally: one CTE per structural edit
maps stable row ids to positions, exactly as a sequential interpreter would;
cell edits join the position table of their epoch.  Independent of the
piece-table code it checks."""

from __future__ import annotations


def _new_name(cols: list[str]) -> str:
    i = 1
    while f"New Column {i}" in cols:
        i += 1
    return f"New Column {i}"


def batch_sql(sheet_sql: str, src_cols: list[str], text_cols: set[str], structural: list[dict],
              cells_sql: str | None, n_sql: str, what: str = "sheet") -> str:
    """``what``: 'sheet' (final sheet) or 'touched' (seq, row, col)."""
    structural = sorted(structural, key=lambda e: e["seq"])
    ctes = [f"sheet AS ({sheet_sql})", "p0 AS (SELECT _row AS id, _row AS pos FROM sheet)"]
    cols = [(k, c) for k, c in enumerate(src_cols)]  # (key, name)
    names = {k: c for k, c in cols}
    epoch_cols = [list(cols)]
    new_ids = 0
    for i, e in enumerate(structural, 1):
        prev = f"p{i - 1}"
        idx, amt = e["index"], e.get("amount", 1)
        if e["type"] == "row" and e["action"] == "create":
            at = f"LEAST({idx}, (SELECT count(*) FROM {prev}))"
            ctes.append(
                f"p{i} AS (SELECT id, CASE WHEN pos >= {at} THEN pos + {amt} ELSE pos END AS pos FROM {prev} "
                f"UNION ALL SELECT ({n_sql}) + {new_ids} + g AS id, {at} + g AS pos FROM range({amt}) t(g))")
            new_ids += amt
        elif e["type"] == "row":
            ctes.append(
                f"p{i} AS (SELECT id, CASE WHEN pos >= {idx + amt} THEN pos - {amt} ELSE pos END AS pos "
                f"FROM {prev} WHERE pos < {idx} OR pos >= {idx + amt})")
        else:
            ctes.append(f"p{i} AS (SELECT * FROM {prev})")
            if e["action"] == "create":
                for _ in range(amt):
                    key = len(names)
                    names[key] = _new_name([c for _, c in cols])
                    cols.insert(idx, (key, names[key]))
            else:
                del cols[idx:idx + amt]
        epoch_cols.append(list(cols))
    n_ep = len(structural) + 1
    bounds = [e["seq"] for e in structural]
    epoch = " + ".join([f"(seq > {b})::INT" for b in bounds]) or "0"
    final = f"p{len(structural)}"

    def vexpr(k):
        if k >= len(src_cols):
            return "CAST(NULL AS VARCHAR)"
        c = src_cols[k]
        return f"s.\"{c}\"" if c not in text_cols else f"CAST(s.\"{c}\" AS VARCHAR)"

    if cells_sql is None:
        sel = ", ".join(f"{vexpr(k)} AS \"{c}\"" for k, c in cols)
        return (f"WITH {', '.join(ctes)} SELECT f.pos AS _row, {sel} "
                f"FROM {final} f LEFT JOIN sheet s ON s._row = f.id")
    ckey = "CASE " + " ".join(
        f"WHEN x.ep = {e} THEN (CASE x.col " + " ".join(f"WHEN {j} THEN {k}" for j, (k, _) in enumerate(ec))
        + " END)" for e, ec in enumerate(epoch_cols)) + " END"
    joins = " UNION ALL ".join(
        f"SELECT c.*, p.id FROM c JOIN p{e} p ON p.pos = c.row WHERE c.ep = {e}" for e in range(n_ep))
    orig = "CASE ck " + " ".join(f"WHEN {k} THEN CAST(s.\"{c}\" AS VARCHAR)" for k, c in enumerate(src_cols)) + " END"
    ctes += [
        f"c0 AS ({cells_sql})",
        f"c AS (SELECT *, {epoch} AS ep FROM c0 WHERE row >= 0 AND col >= 0)",
        f"cj AS (SELECT x.*, {ckey} AS ck FROM ({joins}) x)",
        f"ck AS (SELECT cj.seq, cj.row, cj.col, cj.new_value, cj.id, cj.ck, {orig} AS orig "
        f"FROM cj LEFT JOIN sheet s ON s._row = cj.id WHERE cj.ck IS NOT NULL)",
        "a AS (SELECT *, coalesce(last_value(CASE WHEN new_value <> '' THEN new_value END IGNORE NULLS) OVER "
        "(PARTITION BY id, ck ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), orig) AS anchor FROM ck)",
        "b AS (SELECT *, CASE WHEN new_value = '' THEN CASE WHEN anchor IS NULL THEN NULL ELSE '' END "
        "ELSE new_value END AS ev FROM a)",
        "d AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN orig ELSE lag(ev) OVER w END AS prev, "
        "row_number() OVER (PARTITION BY id, ck ORDER BY seq DESC) AS rn FROM b "
        "WINDOW w AS (PARTITION BY id, ck ORDER BY seq))",
    ]
    if what == "touched":
        return f"WITH {', '.join(ctes)} SELECT seq, row, col FROM d WHERE ev IS DISTINCT FROM prev"
    ctes.append("l AS (SELECT id, ck, ev FROM d WHERE rn = 1)")
    piv = ", ".join(
        f"bool_or(ck = {k}) AS t{k}, max(CASE WHEN ck = {k} THEN ev END) AS e{k}" for k in sorted(names))
    ctes.append(f"pv AS (SELECT id, {piv} FROM l GROUP BY id)")
    sel = ", ".join(
        f"CASE WHEN pv.t{k} THEN pv.e{k} ELSE {vexpr(k) if k < len(src_cols) else 'CAST(NULL AS VARCHAR)'} "
        f"END AS \"{c}\"" for k, c in cols)
    return (f"WITH {', '.join(ctes)} SELECT f.pos AS _row, {sel} FROM {final} f "
            f"LEFT JOIN sheet s ON s._row = f.id LEFT JOIN pv ON pv.id = f.id")
