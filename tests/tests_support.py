from newsmill.session import scratch


def write_text(spark, name, text, path=None):
    """One text file through the file system API; returns its path."""
    path = path or scratch(spark, name) + ".json"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()
    return path
