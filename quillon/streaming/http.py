"""Request and response scoring: POST an event, get its score.

Requests are spooled as JSON files, which a file stream reads; the sink writes one response file an event,
and the waiting request returns it. The spool is read and written by way of Hadoop's file systems, so it may
lie on any storage that all executors share.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import models
from quillon.plans.ir import Node
from quillon.session import hadoop_path


class HttpScoring:
    """Serves until ``stop``; ``schema`` is that of one event, without the request's id."""

    def __init__(self, spark: SparkSession, doc: Node, schema: str, folder: str, port: int = 0, wait_s: float = 30.0, host: str = "127.0.0.1") -> None:
        self.folder = folder
        self.jvm, self.fs = spark._jvm, hadoop_path(spark, folder)[0]
        for name in ("in", "out"):
            self.fs.mkdirs(self._path(f"{folder}/{name}"))
        stream = spark.readStream.schema(f"request_id string, {schema}").json(f"{folder}/in")
        self.query = stream.writeStream.foreachBatch(lambda batch, n: self._answer(models.score(batch, doc, ("request_id",)))).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="200 milliseconds").start()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                try:
                    event = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                    body, code = outer._ask(dict(event), wait_s)
                except (ValueError, TypeError) as err:
                    body, code = json.dumps({"error": str(err)}), 400
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_args: object) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def _ask(self, event: dict, wait_s: float) -> tuple[str, int]:
        k = uuid.uuid4().hex
        self._put(f"{self.folder}/in", k, json.dumps({**event, "request_id": k}))
        until, path = time.time() + wait_s, self._path(f"{self.folder}/out/{k}.json")
        while time.time() < until:
            if self.fs.exists(path):
                found = self.fs.open(path)
                try:
                    return str(self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")), 200
                finally:
                    found.close()
            time.sleep(0.02)
        return json.dumps({"error": "no answer in time"}), 504

    def _path(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _put(self, folder: str, name: str, body: str) -> None:
        """Writes a file under a hidden name, which no reader takes, and renames it when it is whole."""
        hidden = self._path(f"{folder}/.{name}.tmp")
        out = self.fs.create(hidden, True)
        out.write(bytearray(body.encode()))
        out.close()
        self.fs.rename(hidden, self._path(f"{folder}/{name}.json"))

    def _answer(self, scored: DataFrame) -> None:
        """One small file an event: requests come one at a time, so a batch is as small as the open requests."""
        for row in scored.select("request_id", F.to_json(F.struct(*[F.col(c) for c in scored.columns if c != "request_id"])).alias("body")).toLocalIterator():
            self._put(f"{self.folder}/out", row["request_id"], row["body"])

    def stop(self) -> None:
        self.server.shutdown()
        self.query.stop()
