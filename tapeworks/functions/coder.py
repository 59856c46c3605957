"""The adaptive coder as Spark functions of the executors' JVM: one sequence of interval steps an artifact, bit by bit, which
can be made faster but not split.

The class is compiled by the compiler that Spark brings for its own generated code and sent to the executors as a jar.
``kernels`` has the same coder in Python; it is used where no JVM can be reached.
"""

from __future__ import annotations

import tempfile
import zipfile

from pyspark.sql import SparkSession

from .kernels import PROFILES

_JAVA = """
package tapeworks.coder;

public class %(name)s implements %(interface)s {
    static final int[] CONTEXTS = {%(contexts)s}, LIMIT = {%(limits)s}, BY_BYTE = {%(by_byte)s}, BY_BIT = {%(by_bit)s};
    static final long TOP = 0xffffffffL, HALF = 0x80000000L, QUARTER = 0x40000000L;

    int kind;
    int[] zero, one;
    byte[] out;
    int size, held, count;
    long pending;

    void start(int kind) {
        this.kind = kind;
        zero = new int[CONTEXTS[kind]];
        one = new int[CONTEXTS[kind]];
        java.util.Arrays.fill(zero, 1);
        java.util.Arrays.fill(one, 1);
    }

    void count(int c, int bit) {
        if (bit == 1) { one[c]++; } else { zero[c]++; }
        if (zero[c] + one[c] > LIMIT[kind]) {
            zero[c] = Math.max(1, (zero[c] + 1) / 2);
            one[c] = Math.max(1, (one[c] + 1) / 2);
        }
    }

    void put(int bit) {
        held = held << 1 | bit;
        if (++count == 8) {
            if (size == out.length) { out = java.util.Arrays.copyOf(out, (int) Math.min(Integer.MAX_VALUE - 16, size * 2L)); }
            out[size++] = (byte) held;
            held = 0;
            count = 0;
        }
    }

    void emit(int bit) {
        put(bit);
        for (; pending > 0; pending--) { put(1 - bit); }
    }

    byte[] encode(byte[] in, int kind) {
        start(kind);
        out = new byte[in.length + 64];
        size = 0; held = 0; count = 0; pending = 0;
        long low = 0, high = TOP;
        int prev = 0;
        for (int i = 0; i < in.length; i++) {
            int b = in[i] & 255;
            for (int k = 0; k < 8; k++) {
                int bit = b >> 7 - k & 1, c = prev * BY_BYTE[kind] + k * BY_BIT[kind];
                long mid = low + (high - low + 1) * zero[c] / (zero[c] + one[c]) - 1;
                if (bit == 1) { low = mid + 1; } else { high = mid; }
                count(c, bit);
                while (true) {
                    if (high < HALF) { emit(0); }
                    else if (low >= HALF) { emit(1); low -= HALF; high -= HALF; }
                    else if (low >= QUARTER && high < 3 * QUARTER) { pending++; low -= QUARTER; high -= QUARTER; }
                    else { break; }
                    low *= 2;
                    high = high * 2 + 1;
                }
            }
            prev = b;
        }
        pending++;
        emit(low < QUARTER ? 0 : 1);
        while (count > 0) { put(0); }
        return java.util.Arrays.copyOf(out, size);
    }

    byte[] decode(byte[] in, int from, int bytes, int kind) {
        start(kind);
        byte[] back = new byte[bytes];
        long low = 0, high = TOP, value = 0, at = 32, bits = (in.length - from) * 8L;
        for (int i = 0; i < 4; i++) { value = value << 8 | (from + i < in.length ? in[from + i] & 255 : 0); }
        int prev = 0;
        for (int i = 0; i < bytes; i++) {
            int b = 0;
            for (int k = 0; k < 8; k++) {
                int c = prev * BY_BYTE[kind] + k * BY_BIT[kind];
                long mid = low + (high - low + 1) * zero[c] / (zero[c] + one[c]) - 1;
                int bit = value > mid ? 1 : 0;
                if (bit == 1) { low = mid + 1; } else { high = mid; }
                count(c, bit);
                b = b << 1 | bit;
                while (true) {
                    long off;
                    if (high < HALF) { off = 0; }
                    else if (low >= HALF) { off = HALF; }
                    else if (low >= QUARTER && high < 3 * QUARTER) { off = QUARTER; }
                    else { break; }
                    value = (value - off) * 2 | (at < bits ? in[from + (int) (at >> 3)] >> 7 - (int) (at & 7) & 1 : 0);
                    low = (low - off) * 2;
                    high = (high - off) * 2 + 1;
                    at++;
                }
            }
            back[i] = (byte) b;
            prev = b;
        }
        return back;
    }

    %(call)s
}
"""

#: The payload of an artifact, compared with what comes back from it.
_ENCODE = """
    public Object call(Object base, Object kind) {
        if (base == null || kind == null) { return null; }
        byte[] in = (byte[]) base, packed = new Encode().encode(in, ((Integer) kind).intValue());
        if (!java.util.Arrays.equals(in, new Encode().decode(packed, 0, in.length, ((Integer) kind).intValue()))) { throw new IllegalStateException("decode_error: roundtrip check failed"); }
        return packed;
    }
"""

#: The artifact in an envelope whose header holds; null for all others.
_DECODE = """
    public Object call(Object artifact) {
        byte[] in = (byte[]) artifact;
        if (in == null || in.length < 128) { return null; }
        java.nio.ByteBuffer head = java.nio.ByteBuffer.wrap(in, 0, 128).order(java.nio.ByteOrder.LITTLE_ENDIAN);
        int kind = head.getShort(6) - 1;
        long bytes = head.getLong(24);
        if (head.getInt(0) != %(magic)s || kind < 0 || kind >= CONTEXTS.length || head.getLong(32) != in.length || head.getLong(48) != in.length - 128 || bytes < 0 || bytes > Integer.MAX_VALUE - 16) { return null; }
        byte[] own = java.util.Arrays.copyOf(in, 128);
        for (int i = 12; i < 16; i++) { own[i] = 0; }
        java.util.zip.CRC32C crc = new java.util.zip.CRC32C();
        crc.update(own, 0, 128);
        if ((int) crc.getValue() != head.getInt(12)) { return null; }
        return new Decode().decode(in, 128, (int) bytes, kind);
    }
"""


def _source(name: str, interface: str, call: str) -> str:
    of = lambda f: ", ".join(str(f(*p)) for p in PROFILES.values())
    return _JAVA % {
        "name": name, "interface": f"org.apache.spark.sql.api.java.{interface}", "call": call, "contexts": of(lambda n, limit, c: n), "limits": of(lambda n, limit, c: limit),
        "by_byte": of(lambda n, limit, c: c(1, 0) - c(0, 0)), "by_bit": of(lambda n, limit, c: c(0, 1) - c(0, 0)),
    }


def register(spark: SparkSession, magic: int) -> bool:
    """Registers ``tape_code(artifact, profile number)`` and ``tape_open(artifact)``; False where no JVM can be reached."""
    if not hasattr(spark, "_jsparkSession"):
        return False
    if spark._jsparkSession.catalog().functionExists("tape_code"):
        return True
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    sources = {"Encode": _source("Encode", "UDF2", _ENCODE), "Decode": _source("Decode", "UDF1", _DECODE % {"magic": magic})}
    made, jar = {}, f"{tempfile.mkdtemp(prefix='tapeworks-')}/coder.jar"  # executors fetch it from here while the session runs
    with zipfile.ZipFile(jar, "w") as z:
        for name, text in sources.items():
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
            compiler.cook(text)
            for path, code in compiler.getBytecodes().items():
                z.writestr(path.replace(".", "/") + ".class", bytes(code))
            own = compiler.getClassLoader().loadClass(f"tapeworks.coder.{name}")
            made[name] = own.getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
    spark.sparkContext._jsc.addJar(jar)
    binary = jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    spark._jsparkSession.udf().register("tape_code", made["Encode"], binary)
    spark._jsparkSession.udf().register("tape_open", made["Decode"], binary)
    return True
