"""Compiles LmKernel.java in the driver's JVM, sends it to the executors, and registers its functions."""

from __future__ import annotations

import logging
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SCORE, TRAIN = "tidemark_lm_score", "tidemark_lm_train"
_SOURCE = Path(__file__).with_name("LmKernel.java")
#: Of each Spark application: its jar, or none if it can't be made there.
_jars: dict[str, str | None] = {}


def _compiled(spark: SparkSession) -> str | None:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    if jvm.javax.tools.ToolProvider.getSystemJavaCompiler() is None or not jvm.java.lang.ModuleLayer.boot().findModule("jdk.incubator.vector").isPresent():
        return None
    top = Path(tempfile.mkdtemp(prefix="lm-kernel-")).resolve()
    words = ["--add-modules", "jdk.incubator.vector", "-nowarn", "-cp", jvm.System.getProperty("java.class.path"), "-d", str(top), str(_SOURCE)]
    args = gateway.new_array(jvm.java.lang.String, len(words))
    for i, w in enumerate(words):
        args[i] = w
    said = jvm.java.io.StringWriter()
    if jvm.com.sun.tools.javac.Main.compile(args, jvm.java.io.PrintWriter(said)):
        raise RuntimeError(said.toString())
    with zipfile.ZipFile(top / "lm-kernel.jar", "w") as jar:
        for f in sorted(top.glob("*.class")):
            jar.write(f, f.name)
    return str(top / "lm-kernel.jar")


def ready(spark: SparkSession) -> bool:
    """Whether SCORE and TRAIN can be called in this session."""
    app = spark.sparkContext.applicationId
    if app not in _jars:
        _jars[app] = _compiled(spark)
        if _jars[app]:
            spark.sql(f"ADD JAR '{_jars[app]}'")
        else:
            logging.getLogger(__name__).warning("no Java compiler or vector module: blocks are trained and scored in numpy")
    if _jars[app]:
        spark.udf.registerJavaFunction(SCORE, "LmKernel$Score", "binary")
        spark.udf.registerJavaFunction(TRAIN, "LmKernel$Train", "binary")
    return bool(_jars[app])
