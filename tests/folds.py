"""The arrival-order fold in one piece, which the library's own must equal."""

import pandas as pd


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    """The live captures of a log after its rows in (captured_at, seq) order, all in one place: what identity.resolve() must equal."""
    live, by_doi, by_url = {}, {}, {}
    for r in rows.sort_values(["captured_at", "seq"]).itertuples():
        owner, other = by_doi.get(r.doi) if r.doi else None, by_url.get(r.url_hash)
        merged = 0
        if owner is not None and other is not None and other != owner:
            gone = live.pop(other)
            by_doi.pop(gone["doi"], None)
            by_url.pop(gone["url_hash"], None)
            merged = 1 + gone["merged"]
        key = owner if owner is not None else other
        if key is None:
            key = f"{r.url_hash[:16]}-{r.seq}"
            live[key] = {"capture_id": key, "doi": "", "url_hash": "", "first_seq": r.seq, "last_seq": r.seq, "arrivals": 0, "merged": 0}
        c = live[key]
        by_doi.pop(c["doi"], None)
        by_url.pop(c["url_hash"], None)
        c.update(doi=r.doi, url_hash=r.url_hash, last_seq=r.seq, arrivals=c["arrivals"] + 1, merged=c["merged"] + merged)
        if r.doi:
            by_doi[r.doi] = key
        by_url[r.url_hash] = key
    return pd.DataFrame(list(live.values()), columns=["capture_id", "doi", "url_hash", "first_seq", "last_seq", "arrivals", "merged"])
