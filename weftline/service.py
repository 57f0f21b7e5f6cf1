"""The engine over HTTP, as a WSGI application: documents in, answers out, whole or as a stream of events.

    POST /ingest, /documents/update     {"documents": [{text, doc_id?, source?, metadata?, acl?}]}
    DELETE /documents/{doc_id}
    POST /query, /query/stream          {user_message, conversation?, preferences?, metadata_filter?}
    GET /health, /stats

Tenant and principals come from the caller's API key, never from the request. Writes are one at a time. A request is a
batch of one; for many at a time there are ``Engine.run`` and ``streaming.pipelines``.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import functions as F

from weftline.config import SOURCES
from weftline.engine import Engine

DOCUMENT = "text string, doc_id string, source string, metadata map<string,string>, acl array<string>, tenant_id string"
REQUEST = "request_id string, user_message string, tenant_id string, principals array<string>, conversation array<string>, preferences array<string>, metadata_filter map<string,string>"


@dataclass(frozen=True)
class Identity:
    tenant_id: str = "default"
    principals: tuple[str, ...] = ()
    key_id: str = ""


@dataclass
class Keys:
    """API keys by their SHA-256; without any, everyone is of the default tenant."""

    by_hash: dict[str, Identity] = field(default_factory=dict)

    @classmethod
    def of(cls, keys: dict[str, dict]) -> Keys:
        """From key to tenant_id, principals and key_id, each of which may be missing."""
        make = lambda m: Identity(m.get("tenant_id", "default"), tuple(m.get("principals", ())), m.get("key_id") or m.get("tenant_id", "default"))
        return cls({hashlib.sha256(k.encode()).hexdigest(): make(m) for k, m in keys.items()})

    @classmethod
    def from_env(cls, name: str = "WEFTLINE_API_KEYS") -> Keys:
        return cls.of(json.loads(os.environ[name])) if os.environ.get(name) else cls()

    @classmethod
    def from_file(cls, path: str) -> Keys:
        return cls.of(json.loads(Path(path).read_text(encoding="utf-8")))

    def identify(self, key: str | None) -> Identity | None:
        if not self.by_hash:
            return Identity()
        mine = hashlib.sha256((key or "").encode()).hexdigest()
        found = [who for known, who in self.by_hash.items() if hmac.compare_digest(known, mine)]
        return found[0] if key and found else None


class Refused(Exception):
    def __init__(self, status: str, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def _list(body: dict, name: str, kind: type = str) -> list:
    got = body.get(name) or []
    if not isinstance(got, list) or not all(isinstance(x, kind) for x in got):
        raise Refused("422 Unprocessable Entity", f"{name} must be a list of {kind.__name__}")
    return got


def _strings(body: dict, name: str) -> dict | None:
    got = body.get(name)
    if got is not None and not isinstance(got, dict):
        raise Refused("422 Unprocessable Entity", f"{name} must be an object")
    return None if got is None else {str(k): v if v is None or isinstance(v, str) else json.dumps(v) for k, v in got.items()}


class Service:
    def __init__(self, engine: Engine, keys: Keys | None = None, now: Callable[[], float] = time.time):
        self.engine, self.keys, self.now, self.writing = engine, keys or Keys.from_env(), now, threading.Lock()

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        try:
            status, kind, parts = self._route(environ)
        except Refused as e:
            status, kind, parts = e.status, "application/json", [json.dumps({"detail": e.detail}).encode()]
        start_response(status, [("Content-Type", kind)])
        return parts

    def _route(self, environ: dict) -> tuple[str, str, Iterable[bytes]]:
        method, path = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/")
        plain = lambda x: ("200 OK", "application/json", [json.dumps(x).encode()])
        if (method, path) == ("GET", "/health"):
            return plain({"status": "ok", "auth": "enabled" if self.keys.by_hash else "open"})
        bearer = environ.get("HTTP_AUTHORIZATION", "")
        who = self.keys.identify(bearer[7:].strip() if bearer.lower().startswith("bearer ") else environ.get("HTTP_X_API_KEY"))
        if who is None:
            raise Refused("401 Unauthorized", "no valid API key")
        if (method, path) == ("GET", "/stats"):
            mine = self.engine.stats().where(F.col("tenant_id") == who.tenant_id).first()
            return plain({"documents": mine.documents, "chunks": mine.chunks, "tokens": mine.tokens} if mine else {"documents": 0, "chunks": 0, "tokens": 0})
        if method == "DELETE" and path.startswith("/documents/"):
            return plain({"chunks_removed": self._delete(path.removeprefix("/documents/"), who)})
        if method == "POST" and path in ("/ingest", "/documents/update"):
            n = self._write(self._body(environ), who, path != "/ingest")
            return plain({"chunks" if path != "/ingest" else "chunks_added": n, "tenant_id": who.tenant_id})
        if method == "POST" and path in ("/query", "/query/stream"):
            r = self._answer(self._body(environ), who)
            sources = [s.asDict() for s in r.sources]
            if path == "/query":
                return plain({"answer": r.answer, "sources": sources, "low_confidence": r.low_confidence, "backend": r.llm_backend, "prompt_tokens": r.prompt_tokens, "tenant_id": who.tenant_id})
            return "200 OK", "text/event-stream", self._events(r.answer, {"tenant_id": who.tenant_id, "sources": sources, "low_confidence": r.low_confidence})
        raise Refused("404 Not Found", f"no {method} {path}")

    def _body(self, environ: dict) -> dict:
        try:
            body = json.loads(environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)) or b"{}")
        except ValueError as e:
            raise Refused("400 Bad Request", "the body isn't JSON") from e
        if not isinstance(body, dict):
            raise Refused("422 Unprocessable Entity", "the body must be an object")
        return body

    def _mine(self, who: Identity) -> int:
        now = self.engine.chunks()
        return 0 if now is None else now.where(F.col("tenant_id") == who.tenant_id).count()

    def _write(self, body: dict, who: Identity, update: bool) -> int:
        rows = []
        for d in _list(body, "documents", dict):
            if not isinstance(d.get("text"), str):
                raise Refused("422 Unprocessable Entity", "a document needs a text")
            if (source := d.get("source") or "knowledge_base") not in SOURCES:
                raise Refused("422 Unprocessable Entity", f"no source called {source}")
            rows.append((d["text"], d.get("doc_id") or hashlib.sha1(d["text"].encode("utf-8", "replace")).hexdigest()[:16], source, _strings(d, "metadata") or {}, _list(d, "acl"), who.tenant_id))
        docs = self.engine.spark.createDataFrame(rows, DOCUMENT)
        with self.writing:
            before = self._mine(who)
            self.engine.update(docs) if update else self.engine.ingest(docs)
            if not update:
                return self._mine(who) - before
        ids = docs.select("tenant_id", "doc_id").distinct()
        return self.engine.chunks().join(ids, ["tenant_id", "doc_id"], "left_semi").count()

    def _delete(self, doc_id: str, who: Identity) -> int:
        with self.writing:
            before = self._mine(who)
            self.engine.delete(self.engine.spark.createDataFrame([(who.tenant_id, doc_id)], "tenant_id string, doc_id string"))
            gone = before - self._mine(who)
        if not gone:
            raise Refused("404 Not Found", "your tenant has no such document")
        return gone

    def _answer(self, body: dict, who: Identity):
        if not isinstance(body.get("user_message"), str):
            raise Refused("422 Unprocessable Entity", "user_message is missing")
        wanted = body.get("preferences") or []
        terms = [str(x) for x in wanted.values()] if isinstance(wanted, dict) else [str(x) for x in wanted]
        row = ("0", body["user_message"], who.tenant_id, list(who.principals), _list(body, "conversation"), terms, _strings(body, "metadata_filter"))
        return self.engine.run_batch(self.engine.spark.createDataFrame([row], REQUEST), F.lit(self.now())).first()

    def _events(self, answer: str, meta: dict) -> Iterator[bytes]:
        yield f"event: meta\ndata: {json.dumps(meta)}\n\n".encode()
        pieces = answer.split(" ")
        for i, piece in enumerate(pieces):
            yield f"data: {json.dumps({'text': piece + ' ' * (i + 1 < len(pieces))})}\n\n".encode()
        yield b"event: done\ndata: {}\n\n"


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000, keys: Keys | None = None) -> None:
    """Serves until stopped, with the standard library's server; any WSGI server does."""
    from wsgiref.simple_server import make_server

    with make_server(host, port, Service(engine, keys)) as server:
        server.serve_forever()
