"""A session over newline-delimited JSON-RPC: one request a line, one answer a line, nothing of Spark's plans."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import functions as F

from lodestone.arguments import ArgumentError, clamped, only_fields, required_digest, required_text
from lodestone.operators import conflict, graph, temporal
from lodestone.plans.recall import RecallOptions, recall
from lodestone.sources.snapshot import EvidenceStore

#: Error codes of JSON-RPC 2.0.
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603

#: Records of one answer: more withheld ones are marked as cut, a longer trace is refused.
WITHHELD, TRACED = 400, 1000


class Session:
    """The calls of a store; every answer is bounded by its clamped limit."""

    def __init__(self, store: EvidenceStore):
        self.store = store
        self.methods: dict[str, Callable[[dict], object]] = {"recall": self.recall, "trace": self.trace, "as_of": self.as_of, "lookup": self.lookup, "submit_answer": self.submit_answer, "stats": self.stats}

    def _rows(self, df, n: int) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.limit(n).collect()]

    def recall(self, a: dict) -> dict:
        only_fields(a, {"query", "limit", "hops", "as_of", "include_retired", "lexical", "semantic", "entities"})
        o = RecallOptions(required_text(a, "query"), clamped("limit", a.get("limit")), a.get("as_of"), clamped("hops", a.get("hops")), bool(a.get("include_retired")), use_entities=a.get("entities", True), use_lexical=a.get("lexical", True), use_semantic=a.get("semantic", True))
        out = recall(self.store.table("memories"), self.store.table("provenance_edges"), o, self.store.index())
        withheld = [r.record_digest for r in out.withheld.limit(WITHHELD + 1).collect()]
        return {"hits": self._rows(out.hits, o.limit), "withheld": withheld[:WITHHELD], "withheld_cut": len(withheld) > WITHHELD, "counts": self._rows(out.counts, 1)[0], "degraded": out.degraded}

    def trace(self, a: dict) -> list[dict]:
        only_fields(a, {"digest", "hops"})
        seeds = self.store.spark.createDataFrame([(required_digest(a, "digest"),)], "seed string")
        rows = self._rows(graph.in_order(graph.trace(seeds, self.store.table("provenance_edges"), self.store.table("memories"), clamped("trace_hops", a.get("hops")))), TRACED + 1)
        if len(rows) > TRACED:
            raise ArgumentError(f"the trace has more than {TRACED} records: ask for fewer hops")
        return rows

    def as_of(self, a: dict) -> dict:
        only_fields(a, {"instant", "limit"})
        at = temporal.seq_at(self.store.table("memories"), required_text(a, "instant")).first()
        if at.outcome != "Resolved":
            return {"outcome": at.outcome, "first_untimed": at.first_untimed, "records": []}
        n = clamped("as_of_limit", a.get("limit"))
        return {"outcome": at.outcome, "sequence": at.sequence, "records": self._rows(temporal.current_as_of(self.store.table("memories"), at.sequence, n).select("record_digest", "claim"), n)}

    def lookup(self, a: dict) -> dict | None:
        only_fields(a, {"digest"})
        found = self._rows(temporal.lookup(self.store.table("memories"), self.store.spark.createDataFrame([(required_digest(a, "digest"),)], "digest string")), 1)
        return found[0] if found else None

    def submit_answer(self, a: dict) -> dict:
        """Accepted once every contradiction of what is cited is acknowledged with a resolution."""
        only_fields(a, {"cited", "acknowledged"})
        spark = self.store.spark
        cited = [required_digest({"cited": c}, "cited") for c in a.get("cited") or []]
        done = [(required_digest(x, "a"), required_digest(x, "b"), x.get("resolution")) for x in a.get("acknowledged") or []]
        owed = conflict.obligations(spark.createDataFrame([(c,) for c in cited], "digest string"), self.store.table("provenance_edges"), self.store.table("memories"))
        ok, rest = conflict.gate(owed, spark.createDataFrame(done, "a string, b string, resolution string"))
        return {"accepted": ok, "owed": [r.asDict() for r in rest]}

    def stats(self, a: dict) -> dict:
        only_fields(a, set())
        return {r["table"]: r["rows"] for r in self.store.stats().select("table", F.col("rows")).collect()}

    def answer(self, line: str) -> dict | None:
        """The answer to one line; none to a notification."""
        try:
            request = json.loads(line)
        except ValueError:
            return _error(None, PARSE, "not JSON")
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str) or not isinstance(request.get("params", {}), dict):
            return _error(request.get("id") if isinstance(request, dict) else None, REQUEST, "not a request")
        number = request.get("id")
        method = self.methods.get(request["method"])
        if method is None:
            out = _error(number, METHOD, f"unknown method; known: {', '.join(sorted(self.methods))}")
        else:
            try:
                out = {"jsonrpc": "2.0", "id": number, "result": method(request.get("params", {}))}
            except ArgumentError as e:
                out = _error(number, PARAMS, str(e))
            except Exception as e:  # the session outlives a call that failed
                out = _error(number, INTERNAL, str(e).splitlines()[0] if str(e) else type(e).__name__)
        return out if "id" in request else None


def _error(number, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def serve(session: Session, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        if line.strip() and (reply := session.answer(line)) is not None:
            out.write(json.dumps(reply, ensure_ascii=False, separators=(",", ":")) + "\n")
            out.flush()
