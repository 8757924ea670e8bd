"""The engine's requests by path and parameters, as JSON, a small server for them, and a coordinator that asks peers, too."""

from __future__ import annotations

import base64
import datetime
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.cells import TooManySegments
from cohortlake.operators.models import compare
from cohortlake.operators.queries import MOST_FACETS, SKETCHES, Engine, UnsupportedQuery
from cohortlake.plans.filters import FilterError, parse


def instant(text: str | None) -> int | None:
    """Milliseconds of an ISO 8601 instant, in UTC unless it says else; None if it is none."""
    if not text:
        return None
    try:
        at = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
    return round(at.timestamp() * 1000)


def parts(text: str | None) -> list[int] | None:
    found = [int(x) for x in (text or "").split(",") if x.strip().lstrip("-").isdigit()]
    return found or None


def limits_of(params: Mapping[str, str]) -> dict[str, Any]:
    return {"start": instant(params.get("from")), "end": instant(params.get("to")), "parts": parts(params.get("partitions"))}


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def state(engine: Engine, text: str | None, agg: str, **limits) -> dict[str, Any]:
    """An answer with what merges over nodes: bitmaps by bucket of member numbers, or a sketch, in base64. Counts and sums add up as they are."""
    tree = parse(text)
    metric, out = engine.metric(agg, tree), _rows(engine.query(text, agg, **limits))[0]
    if agg != "count" and (metric is None or (metric.type in SKETCHES and engine.exact(metric, tree))):
        out["bitmaps"] = {str(r.b): base64.b64encode(r.bits).decode() for r in engine.bitmaps(text, **limits).collect()}
    elif metric is not None and metric.type in SKETCHES:
        whole = engine.sketches(metric, **limits).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch")).first().sketch
        out["sketch"] = None if whole is None else base64.b64encode(whole).decode()
    return out


def _facets(engine: Engine, found: list[dict[str, Any]]) -> dict[str, list]:
    out: dict[str, list] = {d.name: [] for d in engine.cfg.dimensions}
    for r in sorted(found, key=lambda r: (-r["count"], r["value"])):
        out[r["dim"]].append({"value": r["value"], "count": r["count"]})
    return out


def fetched(url: str, timeout: float = 10.0) -> Any:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return json.loads(answer.read())


class Coordinator:
    """An engine and its peers, by their addresses, as one. A peer that does not answer makes the answer partial."""

    def __init__(self, engine: Engine, peers: Sequence[str], fetch: Callable[[str], Any] = fetched):
        self.engine, self.peers, self.fetch = engine, list(peers), fetch

    def ask(self, path: str, params: Mapping[str, Any]) -> tuple[list[Any], bool]:
        """What the peers say that answer, and whether some did not."""
        url = f"{path}?{urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})}"

        def one(peer: str) -> Any:
            try:
                return self.fetch(f"{peer.rstrip('/')}{url}")
            except (OSError, ValueError):
                return None

        with ThreadPoolExecutor(max(1, len(self.peers))) as pool:
            found = list(pool.map(one, self.peers))
        return [x for x in found if x is not None], any(x is None for x in found)

    def query(self, params: Mapping[str, str]) -> dict[str, Any]:
        agg = params.get("agg") or "count"
        own = state(self.engine, params.get("filter"), agg, **limits_of(params))
        others, partial = self.ask("/internal/query", params)
        every = [own, *others]
        out = {k: sum(x[k] for x in every) for k in ("segments", "matched")} | {"metric": agg, "approx": own["approx"], "partial": partial}
        if "bitmaps" in own:
            whole: dict[str, int] = {}
            for x in every:
                for b, bits in x["bitmaps"].items():
                    whole[b] = whole.get(b, 0) | int.from_bytes(base64.b64decode(bits), "little")
            out["result"] = sum(x.bit_count() for x in whole.values())
        elif "sketch" in own:
            spark = self.engine.cells.sparkSession
            parts = [(bytearray(base64.b64decode(x["sketch"])),) for x in every if x["sketch"]]
            found = spark.createDataFrame(parts, "sketch binary").agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))), F.lit(0)).alias("n")).first().n
            out |= {"result": float(found), "matched": -1}
        else:
            out["result"] = sum(x["result"] for x in every)
        return out

    def facets(self, params: Mapping[str, str], top: int) -> dict[str, Any]:
        """Counts of each value added up. A peer tells its MOST_FACETS most frequent values of a dimension."""
        others, partial = self.ask("/facets", {**params, "topN": str(MOST_FACETS)})
        total: dict[tuple[str, str], int] = {}
        own = _facets(self.engine, _rows(self.engine.facets(params.get("filter"), MOST_FACETS, **limits_of(params))))
        for answer in [own, *others]:
            for dim, values in answer.items():
                for v in values if dim != "partial" else []:
                    total[dim, v["value"]] = total.get((dim, v["value"]), 0) + v["count"]
        found = _facets(self.engine, [{"dim": d, "value": v, "count": n} for (d, v), n in total.items()])
        return {d: v[:top] for d, v in found.items()} | {"partial": partial}

    def timeseries(self, params: Mapping[str, str]) -> list[dict[str, Any]]:
        """Steps over all peers: members of a step are merged, not added."""
        agg, limits = params.get("agg") or "count", limits_of(params)
        steps = _rows(self.engine.timeseries(params.get("bucketSize") or "1h", params.get("filter"), agg, **limits))
        out = []
        for r in sorted(steps, key=lambda r: r["step_start"]):
            text = {k: datetime.datetime.fromtimestamp(r[f"step_{n}"] / 1000, datetime.UTC).isoformat() for k, n in (("from", "start"), ("to", "end"))}
            out.append({"step_start": r["step_start"], "step_end": r["step_end"]} | {k: v for k, v in self.query({**params, **text}).items() if k in ("result", "partial")})
        return out

    def nodes(self) -> list[dict[str, Any]]:
        out = [_node("self", _rows(self.engine.segments()))]
        for peer in self.peers:
            found, away = Coordinator(self.engine, [peer], self.fetch).ask("/segments", {})
            out.append({"node": peer, "up": not away} | ({} if away else {k: v for k, v in _node(peer, found[0]).items() if k not in ("node", "up")}))
        return out

    def segments(self) -> list[dict[str, Any]]:
        out = [r | {"node": "self"} for r in _rows(self.engine.segments())]
        for peer in self.peers:
            for found in Coordinator(self.engine, [peer], self.fetch).ask("/segments", {})[0]:
                out += [r | {"node": peer} for r in found]
        return out


def _node(name: str, segments: list[dict[str, Any]]) -> dict[str, Any]:
    return {"node": name, "up": True, "segments": len(segments), "records": sum(r["records"] for r in segments)}


def handle(engine: Engine, path: str, params: Mapping[str, str], peers: Coordinator | None = None) -> tuple[int, Any]:
    """(status, body) of a request; with peers, of all nodes, but for those that peers ask each other."""
    limits, text, agg = limits_of(params), params.get("filter"), params.get("agg") or "count"
    own = peers is None or params.get("local") == "true"
    try:
        if path == "/health":
            return 200, {"status": "ok"}
        if path == "/internal/query":
            engine.guard(**limits)
            return 200, state(engine, text, agg, **limits)
        if path == "/query":
            engine.guard(**limits)
            if params.get("models"):
                return 200, {"models": _rows(compare(engine, params["models"], text, agg, **limits))}
            return 200, _rows(engine.query(text, agg, **limits))[0] if own else peers.query(params)
        if path == "/facets":
            top = int(params["topN"]) if params.get("topN", "").isdigit() else 20
            return 200, _facets(engine, _rows(engine.facets(text, top, **limits))) if own else peers.facets({**params, "local": "true"}, top)
        if path == "/timeseries":
            if not own:
                return 200, peers.timeseries(params)
            found = engine.timeseries(params.get("bucketSize") or "1h", text, agg, **limits)
            return 200, sorted(_rows(found), key=lambda r: r["step_start"])
        if path == "/segments":
            return 200, sorted(_rows(engine.segments()), key=lambda r: (r["start_ms"], r["part"]))
        if path == "/cardinality":
            return 200, _rows(engine.legacy_cardinality(params.get("dim", ""), params.get("value", "")))[0]
        if path == "/nodes":
            return 200, [_node("self", _rows(engine.segments()))] if own else peers.nodes()
    except (FilterError, UnsupportedQuery, TooManySegments, ValueError) as e:
        return 400, {"error": str(e)}
    return 404, {"error": f"no {path}"}


def serve(engine: Engine, bind: str | None = None):
    """A server over handle(), with the document's peers; the caller runs serve_forever()."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qsl, urlsplit

    peers = Coordinator(engine, engine.cfg.query.peers) if engine.cfg.query.peers else None

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            at = urlsplit(self.path)
            try:
                status, body = handle(engine, at.path, dict(parse_qsl(at.query)), peers)
            except Exception as e:
                status, body = 500, {"error": str(e)}
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    host, _, port = (bind or engine.cfg.query.http.bind).rpartition(":")
    return ThreadingHTTPServer((host, int(port)), Handler)
