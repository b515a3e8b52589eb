"""Deterministic synthetic records and evaluation cases for tests and demonstrations."""

from __future__ import annotations

import random

# Vocabulary of invented records.
GROUPS = {"Sensors": ["Surface Radar", "Sonar Set"], "Vehicles": ["Utility Truck", "Bridge Carrier"], "Vessels": ["Survey Craft", "Supply Craft"]}
PARAMETERS = [("Maximum range", "km", 20, 900), ("Length", "m", 2, 140), ("Empty weight", "kg", 80, 90000), ("Maximum speed", "km/h", 5, 900)]
COUNTRIES = ["Norland", "Sudmark", "Ostrava Isles", "Westria", "Kelvan"]


def records(count: int, seed: int = 7) -> list[dict]:
    """Catalogue-shaped records with sparse parameters, variants, proliferations and relations to earlier records."""
    rng = random.Random(seed)
    out: list[dict] = []
    for i in range(count):
        group = rng.choice(sorted(GROUPS))
        kind, origin, year = rng.choice(GROUPS[group]), rng.choice(COUNTRIES), rng.randint(1950, 2020)
        code = f"{group[:2].upper()}-{100 + i}"
        rows = []
        for name, unit, low, high in PARAMETERS:
            if rng.random() < 0.85:
                for v in range(1 + (rng.random() < 0.15)):
                    rows.append({"seq": 1001 + len(rows), "parameterOnly": name, "parameter": f"{name} - {v + 1}", "parameterValue": str(round(rng.triangular(low, high, (low + high) / 3), 1)),
                                 "uom": unit, "parameterDescr": f"{name} as stated", "dataType": "Number", "component": "General"} | ({"comments": "Export version"} if v else {}))
        related = [{"childModelID": p["modelID"], "childModel": p["nomenclature"], "relationType": "Fitted with", "parentComponent": "General"} for p in rng.sample(out, min(len(out), rng.random() < 0.4))]
        out.append({
            "modelID": 5000 + i, "releaseID": 1, "name": code, "nomenclature": f"{code} {kind}", "systemGroup": group, "systemType": kind, "primaryEquipCode": code,
            "descriptions": [{"descrType": "Overview", "description": f"The {code} is a {kind.lower()} from {origin}. It entered service in {year}.", "classification": "open"}],
            "parametrics": rows, "relations": related, "aliases": [{"alias": f"Project {code[-3:]}", "type": "cover"}], "codes": [{"code": code, "isPrimary": True}],
            "proliferations": [{"country": origin, "proliferation": "Production"}, {"country": rng.choice(COUNTRIES), "proliferation": "Using"}, {"country": origin, "proliferation": str(year), "type": "IOC Year"}]})
    return out


def cases(made: list[dict], seed: int = 11, per_class: int = 5) -> list[dict]:
    """Lookup, parametric, comparison, analytic, prose and negative cases with the ids that answer them."""
    rng = random.Random(seed)
    rid = lambda r: str(r["modelID"])
    out = [{"id": f"lookup-{k}", "class": "lookup", "query": f"What is the {r['name']}?", "expected_rids": [rid(r)], "required_rids": []} for k, r in enumerate(rng.sample(made, per_class))]
    with_rows = [r for r in made if r["parametrics"]]
    for k, r in enumerate(rng.sample(with_rows, per_class)):
        p = rng.choice(r["parametrics"])
        out.append({"id": f"parametric-{k}", "class": "parametric", "query": f"What is the {p['parameterOnly'].lower()} of the {r['name']}?", "expected_rids": [rid(r)], "required_rids": [], "expected_answer_contains": [p["parameterValue"]]})
    for k in range(per_class):
        a, b = rng.sample(made, 2)
        out.append({"id": f"comparison-{k}", "class": "comparison", "query": f"Compare the {a['name']} and the {b['name']}.", "expected_rids": [], "required_rids": [rid(a), rid(b)]})
    for k, g in enumerate(sorted(GROUPS)):
        hits = [rid(r) for r in made if r["systemGroup"] == g and any(p["parameterOnly"] == "Maximum range" and float(p["parameterValue"]) >= 300 for p in r["parametrics"])]
        out.append({"id": f"analytic-{k}", "class": "analytic", "query": f"List all {g} with maximum range over 300 km", "expected_rids": hits[:40], "required_rids": []})
    out += [{"id": f"prose-{k}", "class": "prose", "query": f"Which system of {rng.choice(COUNTRIES)} entered service early?", "expected_rids": [], "required_rids": []} for k in range(per_class)]
    return [*out, {"id": "negative-0", "class": "negative", "query": "What is the boiling point of sand?", "expected_rids": [], "required_rids": [], "expect_refusal": True}]
