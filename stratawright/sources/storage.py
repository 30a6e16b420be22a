"""Small files beside the tables, on whatever file system their path names: local, HDFS or an object store."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _open(path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path on it."""
    context = SparkSession.builder.getOrCreate().sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def _name(status: JavaObject) -> str:
    uri = status.getPath().toUri()
    return uri.getPath() if uri.getScheme() in (None, "file") else uri.toString()


def is_folder(path: str) -> bool:
    system, place = _open(path)
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def exists(path: str) -> bool:
    system, place = _open(path)
    return system.exists(place)


def files_under(path: str) -> list[str]:
    """All files below a folder."""
    system, place = _open(path)
    rest, out = system.listFiles(place, True), []
    while rest.hasNext():
        out.append(_name(rest.next()))
    return out


def read_text(path: str) -> str:
    system, place = _open(path)
    if not system.exists(place):
        raise FileNotFoundError(path)
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Write a small file whole: under another name first, so that no reader sees a part of it."""
    system, place = _open(path)
    other = _open(f"{path}.writing")[1]
    stream = system.create(other, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if system.exists(place):
        system.delete(place, False)
    system.rename(other, place)
