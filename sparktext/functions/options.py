"""Options of an index: algorithms, rank encodings and storage, with their aliases and names."""

from __future__ import annotations

from dataclasses import dataclass

#: Accepted names (any case) of each option.
ALGORITHMS = {"doubling": "doubling", "sais": "sais", "": "sais"}
OCC = {
    "bitvectors": "bitvectors", "bitvector": "bitvectors", "wavelet": "wavelet-tree", "wavelettree": "wavelet-tree", "waveletmatrix": "wavelet-matrix", "wavelet-matrix": "wavelet-matrix", "wm": "wavelet-matrix",
    "rlbwt": "rlbwt", "rindex": "rlbwt", "r-index": "rlbwt", "": "rlbwt", "rrr": "rrr", "rrrvector": "rrr", "rrr-vector": "rrr", "eliasfano": "elias-fano", "elias-fano": "elias-fano", "ef": "elias-fano",
    "poppy": "poppy", "interleaved-rrr": "poppy", "interleaved_rrr": "poppy", "dynamic": "dynamic-bitvectors", "dynamicbitvectors": "dynamic-bitvectors", "dynamic-bitvectors": "dynamic-bitvectors", "dbv": "dynamic-bitvectors",
}
MODES = {"": "memory", "memory": "memory", "in-memory": "memory", "mem": "memory", "external": "external", "disk": "external", "ext": "external"}
STRATEGIES = {"": "lsm", "lsm": "lsm", "bplustree": "bplustree", "b+tree": "bplustree", "bplus": "bplustree", "inverted": "inverted", "inverted-segments": "inverted", "segments": "inverted", "sharded": "inverted"}
BACKENDS = ("fm", "suffixarray", "bifm")
#: The number of each encoding and storage in an index' type mark.
OCC_ID = {"bitvectors": 1, "wavelet-tree": 2, "wavelet-matrix": 3, "rlbwt": 4, "rrr": 5, "elias-fano": 6, "poppy": 7, "dynamic-bitvectors": 8}
PERSIST_ID = {"lsm": 3, "bplustree": 4, "inverted": 5}


def _pick(table: dict[str, str], name: str, what: str, choices: str) -> str:
    try:
        return table[name.lower()]
    except KeyError:
        raise ValueError(f'unknown {what} "{name}": choose {choices}') from None


def parse_algorithm(name: str) -> str:
    return _pick(ALGORITHMS, name, "algorithm", "doubling, sais, or suffixarray")


def parse_occ(name: str) -> str:
    return _pick(OCC, name, "occ structure", "bitvectors, wavelet, waveletmatrix, rlbwt, rrr, eliasfano, poppy, or dynamic")


@dataclass(frozen=True)
class Storage:
    mode: str = "memory"
    strategy: str = "lsm"
    block_size: int = 4096

    def __str__(self) -> str:
        return "memory" if self.mode == "memory" else f"external(strategy={self.strategy},block={self.block_size})"


def parse_storage(mode: str = "", strategy: str = "", block_size: int = 4096) -> Storage:
    m = _pick(MODES, mode, "storage mode", "memory or external")
    s = _pick(STRATEGIES, strategy, "external strategy", "lsm, bplustree, or inverted")
    if block_size <= 0:
        raise ValueError("disk block size must be > 0")
    return Storage(m, s, block_size)


def normalize(occ: str, storage: Storage) -> tuple[str, Storage]:
    """Defaults and rounding: blocks are multiples of 8 from 8 on; only bit vectors and wavelet trees
    have external storage, others fall back to memory; ``external-wavelet`` is a wavelet tree outside."""
    size = storage.block_size if storage.block_size > 0 else 4096
    size = max(8, -(-size // 8) * 8)
    mode = storage.mode
    if occ == "external-wavelet":
        occ, mode = "wavelet-tree", "external"
    if occ not in ("bitvectors", "wavelet-tree"):
        mode = "memory"
    return occ, Storage(mode, storage.strategy if storage.strategy in PERSIST_ID else "lsm", size)


def magic(backend: str, occ: str, storage: Storage) -> str:
    """The type mark of a saved index."""
    if backend == "suffixarray":
        return "SAIDX01"
    if backend == "bifm":
        return "BIDX001"
    persist = PERSIST_ID[storage.strategy] if storage.mode == "external" else 1 if occ == "bitvectors" else 2
    return f"FMI{OCC_ID[occ]:02d}{persist:02d}"
