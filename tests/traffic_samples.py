"""Small traffic of our own, and the request numbers it must give."""

from __future__ import annotations

import random

BROWSER = [
    "User-Agent: Mozilla/5.0 (X11; Linux)",
    "Pragma: no-cache",
    "Accept: text/html,application/xml;q=0.9",
    "Accept-Encoding: gzip, deflate",
    "Accept-Charset: utf-8",
    "Accept-Language: en",
    "Host: shop.test:8080",
]


def request(line: str, headers: list[str], body: list[str] = ()) -> list[str]:
    return [line, *headers, "", *body, ""]


def shop_traffic(seed: int, count: int, attack: bool = False) -> list[str]:
    """Lines of generated shop requests; attacks carry odd queries and extensions."""
    draw = random.Random(seed)
    lines: list[str] = []
    for i in range(count):
        page = draw.choice(["index.jsp", "cart/add.jsp", "img/logo.gif", "style.css"])
        query = draw.choice(["", "?id=3&name=Jam%F3n", "?q=a+b", "?id=1&id=2"])
        method = "GET"
        if attack:
            page = draw.choice(["index.jsp.OLD", "cart/add.jsp", "logo.gif~", "a/b/../c.cnf"])
            query = draw.choice(["?id=%27;+DROP+TABLE+x--", "?q=<script>alert(1)</script>", "?id=||||"])
            method = draw.choice(["GET", "PUT", "POST"])
        headers = [*BROWSER, f"Cookie: S={draw.randrange(10**8):08d}"]
        headers.append(draw.choice(["Connection: close", "Connection: keep-alive"]))
        body: list[str] = []
        if draw.random() < 0.4:
            body = [f"id={i}&text=" + "x" * draw.randrange(1, 60)]
            if draw.random() < 0.3:
                body.append("second line ñ")
            headers += ["Content-Type: application/x-www-form-urlencoded", f"Content-Length: {len(body[0])}"]
            method = "POST" if method == "GET" else method
        lines += request(f"{method} http://shop.test:8080/{page}{query} HTTP/1.1", headers, body)
    return lines


def expected(lines: list[str]) -> list[dict]:
    """Requests of a list of lines, read one after the other."""
    found, at, next_id = [], 0, 1
    while at < len(lines):
        start, head, body = at, [], []
        while at < len(lines) and lines[at] != "":
            head.append(lines[at])
            at += 1
        at += 1
        while at < len(lines) and lines[at] != "":
            body.append(lines[at])
            at += 1
        at += 1
        headers = {}
        for line in head[1:]:
            key, colon, rest = line.partition(":")
            headers[key] = rest[1:] if colon else ""
        found.append(
            {"line_no": start + 1, "id": next_id, "line": head[0], "headers": headers, "body": "\n".join(body)}
        )
        next_id += 1 + len(headers) + (3 if body else 2)
    return found
