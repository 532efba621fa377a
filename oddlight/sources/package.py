"""Model packages: a directory with manifest.json and its artifacts; building is atomic."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..errors import ArtifactCorrupt, ArtifactMissing, ArtifactPathEscape, InvalidArgument, IoFailure
from . import jsontext
from .manifest import Manifest, parse


def sha256_file(path: Path) -> str:
    """Lower-case hexadecimal SHA-256 of a file, or of the files below a directory in order of name."""
    h = hashlib.sha256()
    for p in sorted(x for x in path.rglob("*") if x.is_file() and not x.name.startswith((".", "_"))) if path.is_dir() else [path]:
        with p.open("rb") as f:
            while block := f.read(1 << 16):
                h.update(block)
    return h.hexdigest()


def resolve(root: Path, relative: str, must_exist: bool = True) -> Path:
    """A path inside the package; empty, absolute, climbing and escaping paths are refused."""
    if not relative or os.path.isabs(relative) or relative.startswith(("/", "\\")) or ".." in Path(relative.replace("\\", "/")).parts:
        raise ArtifactPathEscape(f"{relative!r} leaves the package")
    path = (root / relative).resolve()
    if not path.is_relative_to(root.resolve()):
        raise ArtifactPathEscape(f"{relative!r} leaves the package")
    if must_exist and not path.exists():
        raise ArtifactMissing(f"{relative} does not exist")
    return path


@dataclass(frozen=True)
class Package:
    root: Path
    manifest: Manifest

    @classmethod
    def load(cls, path: str | Path) -> Package:
        """From a directory or its manifest.json; every checksum is verified."""
        p = Path(path)
        p = p / "manifest.json" if p.is_dir() else p
        try:
            text = p.read_text(encoding="utf-8")
        except OSError as e:
            raise IoFailure(f"cannot read {p}") from e
        out = cls(p.parent, parse(text))
        for name, want in out.manifest.checksums.items():
            if sha256_file(resolve(out.root, name)) != want:
                raise ArtifactCorrupt(f"the checksum of {name} differs")
        return out

    def validate(self) -> None:
        """All artifacts exist."""
        for name in self.manifest.artifacts():
            resolve(self.root, name)

    def info(self) -> dict[str, Any]:
        m = self.manifest
        return {"id": m.id, "version": m.version, "algorithm": m.algorithm, "graph_contract": m.graph_contract, "backend": m.runtime.backend, "max_batch_size": m.runtime.max_batch_size}


class PackageBuilder:
    """Collects artifacts, a fit and a calibration on top of a template package, then commits once."""

    def __init__(self, template: str | Path) -> None:
        self.template = Package.load(template)
        self.artifacts: dict[str, Path] = {}
        self.edits: list = []

    def add_artifact(self, name: str, source: str | Path) -> PackageBuilder:
        resolve(self.template.root, name, must_exist=False)
        self.artifacts[name] = Path(source)
        return self

    def apply_fit(self, variant: str, statistics: str | None = None) -> PackageBuilder:
        """After a statistical fit: schema 2, variant and statistics; normalising and thresholds wait for calibration."""

        def edit(doc: dict) -> None:
            if variant != "original":
                doc["schema_version"] = 2
                doc["algorithm"] |= {"variant": variant, "statistics": statistics}
                doc.setdefault("postprocess", {}).update(normalize=False, threshold=False)

        self.edits.append(edit)
        return self

    def apply_calibration(self, row) -> PackageBuilder:
        """Ranges and thresholds of a calibration row; pixel fields only where it has them."""
        if not row["image_max"] > row["image_min"] or (row["has_pixel_statistics"] and not row["pixel_max"] > row["pixel_min"]):
            raise InvalidArgument("calibration ranges must not be empty")

        def edit(doc: dict) -> None:
            post = doc.setdefault("postprocess", {})
            post |= {"normalize": True, "threshold": True, **{k: row[k] for k in ("image_min", "image_max", "image_threshold")}}
            if row["has_pixel_statistics"]:
                post |= {k: row[k] for k in ("pixel_min", "pixel_max", "pixel_threshold")}
            doc["postprocess"] = post

        self.edits.append(edit)
        return self

    def commit(self, output: str | Path) -> Package:
        """Copy, overlay, rewrite, checksum, reload, rename. The output must not exist nor lie inside the template."""
        out = Path(output).resolve()
        root = self.template.root.resolve()
        if out.exists():
            raise InvalidArgument(f"{out} exists")
        if out.is_relative_to(root):
            raise InvalidArgument("the output must not lie inside the template")
        if any(p.is_symlink() for p in root.rglob("*")):
            raise InvalidArgument("a template must not hold symbolic links")
        work = out.with_name(f".{out.name}-{uuid.uuid4().hex}")
        try:
            shutil.copytree(root, work)
            for name, source in self.artifacts.items():
                target = resolve(work, name, must_exist=False)
                target.parent.mkdir(parents=True, exist_ok=True)
                if target.is_dir():
                    shutil.rmtree(target)
                (shutil.copytree if source.is_dir() else shutil.copyfile)(source, target)
            doc = jsontext.parse((work / "manifest.json").read_text(encoding="utf-8"))
            for edit in self.edits:
                edit(doc)
            doc["checksums"] = {}
            names = [n for n in parse(jsontext.render(doc)).artifacts() if (work / n).exists()]
            doc["checksums"] = {n: sha256_file(work / n) for n in names}
            (work / "manifest.json").write_text(jsontext.render(doc), encoding="utf-8")
            Package.load(work)
            os.rename(work, out)
        finally:
            shutil.rmtree(work, ignore_errors=True)
        return Package.load(out)
