"""A small invented places service, for queries and tests without a network."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

_PLACES = [
    {"placeId": f"c{i}", "name": f"Canned {i}", "location": {"x": 10.0 + i, "y": 50.0}, "distance": 100.0 * i, "categories": [{"categoryId": str(10000 + i % 3), "label": ("Cafe", "Stadium", "Office")[i % 3]}]} for i in range(1, 8)
]


def fetch(url: str, headers: dict[str, str]) -> tuple[int, str]:
    """Pages of three results, an empty one in between; a wrong token is refused in the body."""
    parts, query = urlsplit(url), {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
    if headers.get("X-Esri-Authorization") != "Bearer canned":
        return 200, json.dumps({"error": {"code": 498, "message": "Invalid token", "details": []}})
    if parts.path.endswith(("/near-point", "/within-extent")):
        page, size = int(query.get("offset", 0)), 3
        found = [p for p in _PLACES if "radius" not in query or p["distance"] <= float(query["radius"])]
        if "categoryIds" in query:
            found = [p for p in found if p["categories"][0]["categoryId"] in query["categoryIds"].split(",")]
        # Page 1 is empty on purpose: a search does not end there.
        results = found[:size] if page == 0 else [] if page == 1 else found[size * (page - 1) : size * page]
        more = page == 0 or size * max(page, 1) < len(found) or (page == 1 and len(found) > size)
        link = url.split("&offset=")[0] + f"&offset={page + 1}" if more else None
        return 200, json.dumps({"results": results, "pagination": {"nextUrl": link}})
    name = parts.path.rsplit("/", 1)[-1]
    if "/places/" in parts.path:
        if place := next((p for p in _PLACES if p["placeId"] == name), None):
            return 200, json.dumps({"placeDetails": {k: v for k, v in place.items() if k != "distance"}})
        return 404, json.dumps({"error": {"code": 404, "message": "No such place"}})
    every = [{"categoryId": str(10000 + i), "fullLabel": ["Places", label]} for i, label in enumerate(("Cafe", "Stadium", "Office"))]
    if name == "categories":
        wanted = query.get("filter", "").lower()
        return 200, json.dumps({"categories": [c for c in every if any(wanted in x.lower() for x in c["fullLabel"])]})
    return 200, json.dumps(next(c for c in every if c["categoryId"] == name))
