"""A client of a model service on this machine: a function from (prompt, schema) to text, for `model_review.asked` and the command line.

Texts under review never leave the machine: an address that is not its own is refused before anything is sent, and no proxy is asked.
"""

from __future__ import annotations

import ipaddress
import json
import urllib.error
import urllib.request
from urllib.parse import urlsplit

#: Fixed values of the service's protocol.
GENERATE, MODELS, DEFAULT = "/api/generate", "/api/tags", "http://127.0.0.1:11434"


def is_local(url: str) -> bool:
    """Whether an address is plain HTTP on this machine, without a name and password in it."""
    try:
        parts = urlsplit(url)
        host, _ = parts.hostname or "", parts.port
    except ValueError:
        return False
    if parts.scheme != "http" or parts.username is not None or parts.password is not None:
        return False
    if host == "localhost":
        return True
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


class LocalModel:
    def __init__(self, model: str, url: str = DEFAULT, timeout: float = 300.0):
        if not is_local(url):
            raise ValueError("a model is asked on this machine only")
        self.model, self.url, self.timeout = model, url.rstrip("/"), timeout

    def _said(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.build_opener(urllib.request.ProxyHandler({}), _NoRedirect()).open(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except TimeoutError:
            raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError from None
            raise ConnectionError("the model's service does not answer") from None

    def __call__(self, prompt: str, schema: dict) -> str:
        return self._said(GENERATE, {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0}} | ({"format": schema} if schema else {}))["response"]

    def status(self) -> str:
        """One of model_review.STATUSES: whether the service answers and has the model."""
        if not self.model:
            return "no_model_configured"
        try:
            names = [m.get("name", "") for m in self._said(MODELS).get("models", [])]
        except TimeoutError:
            return "timeout"
        except ConnectionError:
            return "service_unavailable"
        except ValueError:
            return "invalid_response"
        return "available" if {self.model, f"{self.model}:latest"} & {*names} else "model_missing"

    def warm_up(self) -> str:
        """Loads the model, so that the first question need not wait for it; the status after that."""
        status = self.status()
        if status == "available":
            try:
                self._said(GENERATE, {"model": self.model, "prompt": "", "stream": False})
            except TimeoutError:
                return "timeout"
            except ConnectionError:
                return "service_unavailable"
        return status


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_, **__):
        raise ConnectionError("the model's service sends elsewhere")
