"""Bounded answers as text: Markdown tables, CSV lines and a context block for a model."""

from __future__ import annotations

from .engine import Result


def cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return str(v)


def markdown_table(columns: list[str], rows: list[dict]) -> str:
    columns = columns or list(rows[0] if rows else [])
    if not columns:
        return ""
    shown = lambda v: cell(v).replace("|", "\\|").replace("\n", "<br>")
    line = lambda cells: f"| {' | '.join(cells)} |"
    body = [line(shown(r.get(c)) for c in columns) for r in rows]
    return "\n".join([line(map(shown, columns)), line("---" for _ in columns), *body])


def csv_text(columns: list[str], rows: list[dict]) -> str:
    columns = columns or list(rows[0] if rows else [])
    if not columns:
        return ""

    def shown(v) -> str:
        t = cell(v)
        return '"' + t.replace('"', '""') + '"' if any(x in t for x in '",\n\r') else t

    return "\n".join(",".join(map(shown, line)) for line in [columns, *([r.get(c) for c in columns] for r in rows)])


def context(sql: str, result: Result, max_rows: int = 50) -> str:
    """The query, its counts and its first rows, as Markdown."""
    rows = result.rows[:max_rows]
    head = ["# Query result", "", "```sql", sql.strip(), "```", ""]
    facts = [f"- Rows: {result.row_count}", f"- Rows shown: {len(rows)}", f"- Truncated: {'yes' if result.truncated else 'no'}", ""]
    return "\n".join(head + facts + [markdown_table(result.columns, rows)])
