"""Download lists of archives, driver-side."""

from __future__ import annotations

import time
from pathlib import Path
from urllib.request import urlretrieve
from zipfile import ZipFile


def manifest(path: str | Path) -> list[str]:
    return [line.strip() for line in Path(path).read_text().splitlines() if line.strip()]


def fetch_file(url: str, output: str | Path, overwrite: bool = False, dryrun: bool = False, unzip: bool = False) -> bool:
    """Fetch one archive unless it is there, and unpack it; whether a download was tried. A dry run does nothing."""
    target = Path(output) / url.rsplit("/", 1)[-1]
    wanted = overwrite or not target.is_file()
    if dryrun:
        return wanted
    target.parent.mkdir(parents=True, exist_ok=True)
    if wanted:
        try:
            urlretrieve(url, target)
        except OSError as e:
            print(f"failed to fetch {url}: {e}")
            return True
    if wanted or unzip:
        with ZipFile(target) as z:
            z.extractall(target.parent)
    return wanted


def fetch_many(urls: list[str], output: str | Path, delay: float = 10, dryrun: bool = False, **options) -> int:
    """Fetch all, with a pause after each download; how many were tried."""
    tried = 0
    for url in urls:
        if fetch_file(url, output, dryrun=dryrun, **options):
            tried += 1
            if not dryrun:
                time.sleep(delay)
    return tried
