"""Model files: pinned download, hash gates, staged install, promotion pointer, health verdicts and rollback. Driver side only."""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import json
import os
import re
import shutil
import tarfile
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

REQUIRED = ("model.onnx", "tokenizer.json", "tokenizer_config.json")
PARTIAL_AGE = 15 * 60
LAUNCHES = 2
#: What a health probe plants, and how many of them a fit model finds at least.
ANCHORS = ("jane.doe@example.com", "415-555-0142", "192.168.4.21")
PASS_MARK = 2
#: Stems that some file systems reserve.
RESERVED = {"CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10))}


# The keys of a manifest, and the fields and files that they stand for.
MANIFEST = {
    "version": "version", "sourceURL": "url", "archiveSHA256": "archive_sha256", "weightsSHA256": "weights_sha256",
    "bytes": "archive_bytes", "maxWidth": "max_width", "maxSequenceLength": "max_sequence",
}
MANIFEST_FILES = {"tokenizerSHA256": "tokenizer.json", "tokenizerConfigSHA256": "tokenizer_config.json"}


class InstallError(Exception):
    """kind: space, permission, offline or download."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def classify(error: BaseException) -> str:
    """Of what kind a failure is, in this order: space, permission, offline, download."""
    import errno

    number = getattr(error, "errno", None) or getattr(getattr(error, "reason", None), "errno", None)
    if isinstance(error, InstallError):
        return error.kind
    if number in (errno.ENOSPC, errno.EDQUOT):
        return "space"
    if isinstance(error, PermissionError) or number in (errno.EACCES, errno.EPERM, errno.EROFS):
        return "permission"
    if isinstance(error, (TimeoutError, ConnectionError)) or isinstance(error, urllib.request.URLError) and not isinstance(error, urllib.request.HTTPError):
        return "offline"
    return "download"


def safe_component(name: str) -> bool:
    """Whether a name can be one path component on any system."""
    return bool(re.fullmatch(r"[A-Za-z0-9._-]+", name)) and name not in (".", "..") and name.split(".")[0].upper() not in RESERVED


def same_digest(a: str, b: str) -> bool:
    return hmac.compare_digest(a.lower().encode(), b.lower().encode())


def digest_of(stream) -> str:
    """The lowercase SHA-256 of a binary stream, read piece by piece."""
    return hashlib.file_digest(stream, "sha256").hexdigest()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return digest_of(f)


def progress(done: int, total: int) -> float:
    """The share that is done, 1 at most."""
    return min(1.0, done / total)


def same_volume(a: str, b: str) -> bool:
    """Whether two paths, or the nearest folders above them that exist, are on one file system: a rename between them is atomic."""

    def device(path: str) -> int:
        path = os.path.abspath(path)
        while not os.path.exists(path) and os.path.dirname(path) != path:
            path = os.path.dirname(path)
        return os.stat(path).st_dev

    return device(a) == device(b)


def disk_needed(archive_bytes: int) -> tuple[int, int]:
    """(to install, to unpack): five and three halves of the archive."""
    return archive_bytes * 5 // 2, archive_bytes * 3 // 2


@dataclass(frozen=True)
class ModelPin:
    version: str
    url: str
    archive_sha256: str
    weights_sha256: str
    archive_bytes: int
    max_width: int = 12
    max_sequence: int = 768
    file_sha256: dict[str, str] = field(default_factory=dict)

    def plausible(self) -> bool:
        return safe_component(self.version) and 0 < self.archive_bytes < 100_000_000_000

    def relocated(self, url: str) -> ModelPin:
        if not urllib.parse.urlparse(url).scheme:
            raise ValueError("the address must be absolute")
        return replace(self, url=url)

    @classmethod
    def from_json(cls, path: str) -> ModelPin:
        """From a manifest; its hashes of the loose files are checked at each load, beside the weights'."""
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        missing = [k for k in MANIFEST if k not in found]
        if missing:
            raise ValueError(f"the manifest lacks {', '.join(missing)}")
        files = {name: found["files"][k] for k, name in MANIFEST_FILES.items() if k in found.get("files", {})}
        pin = cls(**{name: found[k] for k, name in MANIFEST.items()})
        return replace(pin, file_sha256={"model.onnx": pin.weights_sha256, **files} if files else {})


def predecessor(pins: list[ModelPin], version: str) -> ModelPin | None:
    at = next((i for i, p in enumerate(pins) if p.version == version), 0)
    return pins[at - 1] if at > 0 else None


def is_complete(folder: str) -> bool:
    return all(os.path.isfile(os.path.join(folder, x)) for x in REQUIRED)


def verified(folder: str, pin: ModelPin) -> bool:
    """Whether the files are those of the pin: checked at each load where it names their hashes."""
    hashes = pin.file_sha256 or {"model.onnx": pin.weights_sha256}
    return is_complete(folder) and all(same_digest(file_digest(os.path.join(folder, k)), v) for k, v in hashes.items())


def _replaced(path: str, content: str) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(temporary, path)


class ModelStore:
    """Installed versions below a root, a text pointer to the promoted one, and what is known of the loaded one."""

    def __init__(self, root: str, overrides: tuple[str, ...] = (), on_change: Callable[[str], None] | None = None):
        self.root, self.overrides, self.on_change = root, overrides, on_change
        self.state, self.generation, self._installed = "unknown", 0, False

    def pointer(self) -> str:
        return os.path.join(self.root, "current")

    def promoted(self) -> str | None:
        """The folder that the pointer names; None where it names none that is safe."""
        with contextlib.suppress(OSError):
            if os.path.islink(self.pointer()):
                name = os.path.basename(os.readlink(self.pointer()))
            else:
                with open(self.pointer(), encoding="utf-8") as f:
                    name = f.read().strip()
            if safe_component(name):
                return os.path.join(self.root, name)
        return None

    def point_at(self, version: str) -> None:
        if not safe_component(version):
            raise ValueError("not a safe version name")
        if os.path.isdir(self.pointer()) and not os.path.islink(self.pointer()):
            raise InstallError("permission", "a folder stands where the pointer goes")
        _replaced(self.pointer(), version)

    def resolved(self) -> str | None:
        """The first complete folder of the overrides and the promoted version."""
        return next((d for d in (*self.overrides, self.promoted()) if d and is_complete(d)), None)

    def installed(self) -> bool:
        self._installed = self._installed or self.resolved() is not None
        return self._installed

    def _set(self, state: str) -> None:
        if state != self.state:
            self.state = state
            if self.on_change:
                self.on_change(state)

    def mark_loaded(self) -> None:
        self._set("loaded")

    def mark_unusable(self) -> None:
        self._set("unusable")

    def invalidate(self) -> None:
        self.generation += 1
        self._set("unknown")


class Installer:
    """Fetches over HTTP by ``opener`` (urllib's; a test's or a proxy's may stand in) or from ``file://``.

    checking -> downloading -> verifying -> installing -> installed, or up to date."""

    def __init__(self, store: ModelStore, pin: ModelPin, free: Callable[[str], int] = lambda p: shutil.disk_usage(p).free, opener: Callable = urllib.request.urlopen):
        self.store, self.pin, self.free, self.opener, self.phase = store, pin, free, opener, "idle"

    def sweep(self, now: float | None = None) -> None:
        for name in os.listdir(self.store.root) if os.path.isdir(self.store.root) else ():
            path = os.path.join(self.store.root, name)
            if name.startswith((".download-", ".staging-", ".current-", ".old-")) and (now or time.time()) - os.lstat(path).st_mtime > PARTIAL_AGE:
                shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)

    def _download(self, to: str, on_progress: Callable[[float], None]) -> None:
        url = urllib.parse.urlparse(self.pin.url)
        if url.scheme == "file":
            shutil.copyfile(urllib.request.url2pathname(url.path), to)
            on_progress(1.0)
            return
        with self.opener(self.pin.url, timeout=20) as source, open(to, "wb") as out:
            done = 0
            while piece := source.read(1 << 20):
                out.write(piece)
                done += len(piece)
                on_progress(progress(done, self.pin.archive_bytes))

    def ensure(self, force: bool = False, skipping: tuple[str, ...] = (), on_progress: Callable[[float], None] = lambda x: None) -> str:
        """installed, up_to_date or blocked; raises InstallError."""
        root, pin = self.store.root, self.pin
        self.phase = "checking"
        try:
            os.makedirs(root, exist_ok=True)
            self.sweep()
            if not pin.plausible():
                raise InstallError("download", "implausible pin")
            target = os.path.join(root, pin.version)
            if pin.version in skipping and self.store.resolved():
                return "blocked"
            if not force and self.store.promoted() == target and is_complete(target):
                self.phase = "up to date"
                return "up_to_date"
            if self.free(root) < disk_needed(pin.archive_bytes)[0]:
                raise InstallError("space")
            if not same_volume(root, target):
                raise InstallError("permission", "the version's folder is on another volume")
            archive = os.path.join(root, f".download-{uuid.uuid4().hex}")
            staging = os.path.join(root, f".staging-{uuid.uuid4().hex}")
            try:
                self.phase = "downloading"
                self._download(archive, on_progress)
                self.phase = "verifying"
                if not same_digest(file_digest(archive), pin.archive_sha256):
                    raise InstallError("download", "the archive's hash differs")
                if self.free(root) < disk_needed(pin.archive_bytes)[1]:
                    raise InstallError("space")
                self.phase = "installing"
                with tarfile.open(archive, "r:gz") as t:
                    t.extractall(staging, filter="data")
                if not is_complete(staging) or not same_digest(file_digest(os.path.join(staging, "model.onnx")), pin.weights_sha256):
                    raise InstallError("download", "files are missing or the weights' hash differs")
                if os.path.isdir(target):
                    os.replace(target, os.path.join(root, f".old-{uuid.uuid4().hex}"))
                os.replace(staging, target)
                self.store.point_at(pin.version)
                self.store.invalidate()
                self.phase = "installed"
                return "installed"
            finally:
                with contextlib.suppress(OSError):
                    os.remove(archive)
                shutil.rmtree(staging, ignore_errors=True)
        except (OSError, tarfile.TarError) as e:
            raise InstallError(classify(e), str(e)) from e


class RecordFile:
    """A small JSON record; a missing or torn file reads as no record."""

    def __init__(self, path: str):
        self.path = path

    def read(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                x = json.load(f)
            return x if isinstance(x, dict) else {}
        except (OSError, ValueError):
            return {}

    def write(self, record: dict) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        _replaced(self.path, json.dumps(record))


def passes(ran: bool, found: int) -> bool:
    return ran and found >= PASS_MARK


class Rollback:
    """Probation of a new version: two launches to prove itself, else back to the one before and blocked."""

    def __init__(self, store: ModelStore, records: RecordFile, pins: list[ModelPin]):
        self.store, self.records, self.pins = store, records, pins

    def _known(self, version: str) -> bool:
        return any(p.version == version for p in self.pins)

    def _here(self, version: str) -> bool:
        return is_complete(os.path.join(self.store.root, version))

    def armed(self) -> dict | None:
        return self.records.read().get("probation")

    def blocked(self) -> list[str]:
        return list(self.records.read().get("failed", []))

    def _put(self, probation: dict | None, failed: list[str] | None = None) -> None:
        self.records.write({"probation": probation, "failed": self.blocked() if failed is None else failed})

    def arm(self, new: str, previous: str) -> bool:
        if new == previous or not (self._here(previous) or self._known(previous)):
            return False
        self._put({"new": new, "previous": previous, "attempts": 0})
        return True

    def confirm(self) -> None:
        self._put(None)

    def block(self, version: str) -> None:
        self._put(self.armed(), [*dict.fromkeys([*self.blocked(), version])])

    def clear_blocklist(self) -> None:
        self._put(self.armed(), [])

    def at_launch(self) -> str:
        """idle, proving or reverted."""
        if not (x := self.armed()):
            return "idle"
        if x["attempts"] < LAUNCHES:
            self._put(x | {"attempts": x["attempts"] + 1})
            return "proving"
        self.block(x["new"])
        self.revert()
        return "reverted"

    def verify(self, probe: Callable[[], tuple[bool, int]]) -> str:
        """confirmed, reverted, inconclusive or idle; probe gives (ran, how many were found)."""
        if not (x := self.armed()):
            return "idle"
        ran, found = probe()
        if (now := self.armed()) is None or now["new"] != x["new"]:
            return "idle"
        if passes(ran, found):
            self.confirm()
            return "confirmed"
        if not ran and not self._here(x["new"]):
            return "inconclusive"
        self.block(x["new"])
        self.revert()
        return "reverted"

    def pending_download(self) -> ModelPin | None:
        """The pin to fetch before a revert can be made."""
        x = self.armed()
        return next((p for p in self.pins if x and p.version == x["previous"] and not self._here(p.version)), None)

    def revert(self) -> bool:
        if not (x := self.armed()):
            return False
        if self._here(x["previous"]):
            self.store.point_at(x["previous"])
            self.store.invalidate()
            self._put(None)
            return True
        if not self._known(x["previous"]):
            self._put(None)
        return False

    def revert_installing(self, on_progress: Callable[[float], None] = lambda x: None) -> bool:
        if pin := self.pending_download():
            Installer(self.store, pin).ensure(force=True, on_progress=on_progress)
        return self.revert()
