"""The metrics endpoint: a small HTTP server on the driver that gives the latest samples as text."""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class MetricsServer:
    """GET on the path gives the metrics, `/health` and `/healthz` give OK, anything else 404."""

    def __init__(self, text: Callable[[], str], host: str = "127.0.0.1", port: int = 9090, path: str = "/metrics") -> None:
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                if self.path == path:
                    code, body, kind = 200, text(), "text/plain; version=0.0.4"
                elif self.path in ("/health", "/healthz"):
                    code, body, kind = 200, "OK", "text/plain"
                else:
                    code, body, kind = 404, "Not Found", "text/plain"
                raw = body.encode()
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def start(self) -> MetricsServer:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
