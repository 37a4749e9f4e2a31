"""Java functions for columns, compiled when first used.

Spark carries a Java compiler (Janino, for its own generated code). Source text is compiled by
it on the driver, packed as a JAR, put in the shared folder and added to the session, so
executors load it like any other JAR. A session registers each function once.
"""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string

from .common import shared_dir


def compiled(spark: SparkSession, source: str) -> dict[str, bytes]:
    """Class files of Java source, by class name."""
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(source)
    classes = compiler.getBytecodes()
    return {name: bytes(classes[name]) for name in classes}


def jar(classes: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, code in sorted(classes.items()):
            z.writestr(zipfile.ZipInfo(name.replace(".", "/") + ".class"), code)
    return out.getvalue()


def register(spark: SparkSession, source: str, functions: dict[str, tuple[str, str]]) -> dict[str, str]:
    """Names to call in SQL for ``functions``, each with its class and return type.

    Classes and names carry a hash of the source as ``VERSION``, so versions don't mix.
    """
    version = hashlib.sha256(source.encode()).hexdigest()[:12]
    names = {f: f"{f}_{version}" for f in functions}
    missing = [f for f in functions if not spark.catalog.functionExists(names[f])]
    if missing:
        raw = jar(compiled(spark, source.replace("VERSION", version)))
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/functions-{version}.jar")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(raw))
        out.close()
        spark.sql(f"ADD JAR '{path.toString()}'")
        for f in missing:
            name, kind = functions[f]
            loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
            made = spark._jvm.java.lang.Class.forName(name.replace("VERSION", version), True, loader).newInstance()
            spark._jsparkSession.udf().register(names[f], made, spark._jsparkSession.parseDataType(_parse_datatype_string(kind).json()))
    return names
