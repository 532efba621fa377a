"""Typed errors: an internal code for each failure and the public status that it maps to."""

from __future__ import annotations

#: Public status numbers by name.
STATUS = {
    "OK": 0,
    "INVALID_ARGUMENT": 1,
    "INVALID_IMAGE": 2,
    "IO_ERROR": 3,
    "INVALID_MODEL_PACKAGE": 4,
    "UNSUPPORTED": 5,
    "PLUGIN_NOT_FOUND": 6,
    "PLUGIN_ABI_MISMATCH": 7,
    "INFERENCE_FAILED": 8,
    "OUT_OF_MEMORY": 9,
    "CANCELLED": 10,
    "ALGORITHM_MISMATCH": 11,
    "INTERNAL_ERROR": 100,
}


class AnomalyError(Exception):
    """Base of all errors raised here; ``code`` names the failure, ``status`` is the public number."""

    code = "InternalError"
    public = "INTERNAL_ERROR"

    def __init__(self, message: str, path: str | None = None) -> None:
        super().__init__(f"{path}: {message}" if path else message)
        self.path = path

    @property
    def status(self) -> int:
        return STATUS[self.public]


def _kind(code: str, public: str) -> type[AnomalyError]:
    return type(code, (AnomalyError,), {"code": code, "public": public, "__doc__": f"{code} ({public})."})


InvalidArgument = _kind("InvalidArgument", "INVALID_ARGUMENT")
InvalidImage = _kind("InvalidImage", "INVALID_IMAGE")
IoFailure = _kind("IoError", "IO_ERROR")
InvalidManifest = _kind("InvalidManifest", "INVALID_MODEL_PACKAGE")
UnsupportedSchema = _kind("UnsupportedSchema", "INVALID_MODEL_PACKAGE")
UnsupportedAlgorithm = _kind("UnsupportedAlgorithm", "UNSUPPORTED")
ArtifactMissing = _kind("ArtifactMissing", "INVALID_MODEL_PACKAGE")
ArtifactPathEscape = _kind("ArtifactPathEscape", "INVALID_MODEL_PACKAGE")
ArtifactCorrupt = _kind("ArtifactCorrupt", "INVALID_MODEL_PACKAGE")
TensorSignatureMismatch = _kind("TensorSignatureMismatch", "INVALID_MODEL_PACKAGE")
TensorShapeMismatch = _kind("TensorShapeMismatch", "INFERENCE_FAILED")
TensorTypeMismatch = _kind("TensorTypeMismatch", "INFERENCE_FAILED")
BackendFailure = _kind("BackendFailure", "INFERENCE_FAILED")
AdapterFailure = _kind("AdapterFailure", "INFERENCE_FAILED")
NotInitialized = _kind("NotInitialized", "INVALID_ARGUMENT")
Cancelled = _kind("Cancelled", "CANCELLED")
AlgorithmMismatch = _kind("AlgorithmMismatch", "ALGORITHM_MISMATCH")
