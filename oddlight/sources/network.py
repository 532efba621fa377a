"""Network stage: an ONNX model over preprocessed tensors, one session for each Python worker."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import BackendFailure, TensorSignatureMismatch
from ..operators.features import TENSOR
from .manifest import Runtime

_sessions: dict = {}


def _session(model: bytes, cfg: dict):
    import onnxruntime as ort

    key = hash(model)
    if key not in _sessions:
        o = ort.SessionOptions()
        level = {"disabled": "ORT_DISABLE_ALL", "basic": "ORT_ENABLE_BASIC", "extended": "ORT_ENABLE_EXTENDED", "all": "ORT_ENABLE_ALL"}
        o.graph_optimization_level = getattr(ort.GraphOptimizationLevel, level[cfg["graph_optimization"]])
        o.execution_mode = ort.ExecutionMode.ORT_PARALLEL if cfg["execution_mode"] == "parallel" else ort.ExecutionMode.ORT_SEQUENTIAL
        o.intra_op_num_threads, o.inter_op_num_threads = cfg["intra_op_threads"] or 1, cfg["inter_op_threads"] or 1
        _sessions[key] = ort.InferenceSession(model, o, providers=["CPUExecutionProvider"])
    return _sessions[key]


def execution_info(runtime: Runtime) -> dict:
    """What runs: the CPU candidate, and whether that is a fallback from a requested accelerator."""
    return {"requested": runtime.backend, "used": "onnxruntime", "device": "cpu", "fallback": runtime.backend != "onnxruntime"}


def infer(spark: SparkSession, tensors: DataFrame, model: bytes, input_name: str, outputs: dict[str, str], runtime: Runtime, timer=None) -> DataFrame:
    """Tensor rows for every output, named by its meaning; images are run in chunks of the largest batch.

    ``outputs`` binds semantic names to output tensors. The model travels as a broadcast. timer is an accumulator of
    milliseconds spent in the network.
    """
    shared = spark.sparkContext.broadcast(model)
    cfg = {k: getattr(runtime, k) for k in ("graph_optimization", "execution_mode", "intra_op_threads", "inter_op_threads")}
    most = runtime.max_batch_size

    def run(batches):
        session = _session(shared.value, cfg)
        if input_name not in {i.name for i in session.get_inputs()}:
            raise TensorSignatureMismatch(f"the model has no input {input_name}")
        names = {o.name for o in session.get_outputs()}
        if missing := set(outputs.values()) - names:
            raise TensorSignatureMismatch(f"the model has no output {sorted(missing)}")
        for b in batches:
            ids = b.column(0).to_pylist()
            c, h, w = (b.column(i).to_pylist() for i in (2, 3, 4))
            x = [np.asarray(d.values, np.float32).reshape(i, j, k) for d, i, j, k in zip(b.column(5), c, h, w, strict=True)]
            for at in range(0, len(x), most):
                began = time.perf_counter()
                try:
                    got = session.run(list(outputs.values()), {input_name: np.stack(x[at : at + most])})
                except Exception as e:
                    raise BackendFailure(str(e)) from e
                if timer is not None:
                    timer.add(1000 * (time.perf_counter() - began))
                for name, value in zip(outputs, got, strict=True):
                    planes = [np.asarray(v, float).reshape((1,) * (3 - v.ndim) + v.shape) for v in value]
                    shape = [pa.array([p.shape[i] for p in planes], pa.int32()) for i in range(3)]
                    yield pa.record_batch([pa.array(ids[at : at + most], pa.int64()), pa.array([name] * len(planes)), *shape, pa.array([p.ravel() for p in planes], pa.list_(pa.float64()))], ["image_id", "name", "c", "h", "w", "data"])

    return tensors.select("image_id", "name", "c", "h", "w", "data").mapInArrow(run, TENSOR)


def warm_up(spark: SparkSession, model: bytes, input_name: str, shape: tuple[int, int, int], outputs: dict[str, str], runtime: Runtime) -> int:
    """Runs one zero image; the number of output tensors."""
    zero = spark.createDataFrame([(0, input_name, *shape, [0.0] * int(np.prod(shape)))], TENSOR)
    return infer(spark, zero, model, input_name, outputs, runtime).count()
