"""A local observatory (SRC10): the pipelines' results as JSON, and one plain page that shows them."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from ..operators.presentation import quadrant, stability_cards
from ..sources.inputs import as_json
from . import pipelines

PAGE = """<!doctype html><meta charset="utf-8"><title>latentfield</title>
<h1>latentfield</h1><nav><a href="#scan">scan</a> <a href="#discover">discover</a> <a href="#reflect">reflect</a></nav><table id="t"></table>
<script>
async function load() {
  const name = location.hash.slice(1) || "scan", found = await (await fetch("/api/" + name)).json();
  const rows = found.level2 || found, columns = Object.keys(rows[0] || {}), table = document.getElementById("t");
  table.replaceChildren();
  for (const r of [Object.fromEntries(columns.map(c => [c, c])), ...rows]) {
    const line = table.insertRow();
    for (const c of columns) line.insertCell().textContent = typeof r[c] === "object" ? JSON.stringify(r[c]) : r[c];
  }
}
addEventListener("hashchange", load); load();
</script>"""


def rows(df: DataFrame) -> list[dict]:
    """One row for each capability; reports over declared or proposed capabilities are small."""
    return [json.loads(r.json) for r in as_json(df).toLocalIterator()]


def answer(spark: SparkSession, root: str, data: str, path: str) -> object | None:
    if path == "/api/scan":
        return rows(pipelines.scan(spark, root, data))
    if path == "/api/discover":
        return rows(pipelines.discover(spark, root, data))
    if path == "/api/reflect":
        two, three = pipelines.reflection(spark, root, data)
        return {"level2": rows(two), "level3": rows(three), "cards": rows(stability_cards(two, three))}
    if path == "/api/quadrant":
        return rows(quadrant(pipelines.scan(spark, root, data)))
    return None


def server(spark: SparkSession, root: str, data: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            code, kind = 200, "application/json"
            try:
                found = answer(spark, root, data, self.path)
                body = PAGE if found is None else json.dumps(found)
                kind = "text/html; charset=utf-8" if found is None else kind
            except Exception as e:  # noqa: BLE001  whatever fails is told to the page
                code, body = 500, json.dumps({"error": str(e)})
            self.send_response(code)
            self.send_header("content-type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(spark: SparkSession, root: str, data: str, port: int) -> None:
    with server(spark, root, data, port) as s:
        print(f"http://localhost:{port}")
        s.serve_forever()
