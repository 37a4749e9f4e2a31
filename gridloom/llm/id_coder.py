"""Java source of the id coder: see ``token_file`` for what it does."""

#: Returns for EncodeVERSION: bytes of the code section. DocsVERSION: doc_id, offset, count and
#: CRC-32 of each document, flat. IdsVERSION: all ids. Little-endian throughout.
SOURCE = r"""
package gridloom.vVERSION;

public final class CoderVERSION {
    static final int NODES = 1 << 17, PAIRS = 1 << 16, SEEN = 1 << 15, HALF = 1 << 31, LEVELS = 6, MIXED = 1;
    static final int[] STRETCH = new int[4096], SQUASH = new int[4096], SHARE = new int[1024];
    static {
        for (int i = 0; i < 4096; i++) {
            double p = (i + 0.5) / 4096;
            STRETCH[i] = (int) StrictMath.max(-2047, StrictMath.min(2047, StrictMath.rint(256 * StrictMath.log(p / (1 - p)))));
            SQUASH[i] = (int) StrictMath.max(16, StrictMath.min(65520, StrictMath.rint(65536 / (1 + StrictMath.exp((2048 - i) / 256.0)))));
        }
        for (int i = 0; i < 1024; i++) SHARE[i] = (int) (65536 / (i + 2.1));
    }

    final boolean decoding;
    byte[] buf;
    int at;
    final int end;
    int lo = 0, hi = -1, code = 0;
    // chances of a 1 (22 bits) over how often it was met (10 bits)
    final int[] top = new int[1 << LEVELS], rare = new int[2 << LEVELS], one = new int[PAIRS], flags = new int[2176];
    final int[] first = new int[SEEN], second = new int[SEEN];
    final int[] weights = new int[64];
    final int ranks;
    final Bits plain;

    // ranks: how many ids have one; plain: bits that no chance tells
    CoderVERSION(boolean decoding, byte[] buf, int at, int end, int ranks, Bits plain) {
        this.ranks = ranks;
        this.plain = plain;
        java.util.Arrays.fill(top, HALF);
        java.util.Arrays.fill(rare, HALF);
        this.decoding = decoding;
        this.buf = buf;
        this.at = at;
        this.end = end;
        java.util.Arrays.fill(one, HALF);
        java.util.Arrays.fill(flags, HALF);
        java.util.Arrays.fill(weights, 36000);
        if (decoding) for (int i = 0; i < 4; i++) code = code << 8 | next();
    }

    // bits in bytes, upper ones first
    static final class Bits {
        byte[] buf;
        int at, end, left = 0;
        long held = 0;

        Bits(byte[] buf, int at, int end) {
            this.buf = buf;
            this.at = at;
            this.end = end;
        }

        void put(int v, int n) {
            held = held << n | v;
            left += n;
            while (left >= 8) {
                left -= 8;
                if (at == buf.length) buf = java.util.Arrays.copyOf(buf, 2 * at + 64);
                buf[at++] = (byte) (held >>> left);
            }
        }

        int get(int n) {
            while (left < n) {
                held = held << 8 | (at < end ? buf[at] & 255 : 0);
                at++;
                left += 8;
            }
            left -= n;
            return (int) (held >>> left) & (1 << n) - 1;
        }

        void flush() {
            if (left > 0) put(0, 8 - left);
        }
    }

    // numbers fall into bins that are four to an octave: values up to 7 alone, then 2, 4, 8 and more together
    static int bin(int v) {
        if (v < 4) return v;
        int k = 31 - Integer.numberOfLeadingZeros(v);
        return k - 1 << 2 | v >>> k - 2 & 3;
    }

    // ids met twice or more, often met ones first: by bins of their counts, in each by id
    static int[] ranked(int[] ids) {
        int[] count = new int[NODES], size = new int[128], from = new int[128];
        for (int i = 0; i < ids.length; i++) count[ids[i]]++;
        int all = 0;
        for (int x = 0; x < NODES; x++) if (count[x] > 1) size[bin(count[x])]++;
        for (int b = 127; b >= 0; b--) {
            from[b] = all;
            all += size[b];
        }
        int[] list = new int[all];
        for (int x = 0; x < NODES; x++) if (count[x] > 1) list[from[bin(count[x])]++] = x;
        return java.util.Arrays.copyOf(list, Math.min(all, NODES - 1));
    }

    // the list as runs of rising ids: a run's length and a shift, then gaps, their upper part in ones
    static byte[] written(int[] list) {
        Bits out = new Bits(new byte[2 * list.length + 64], 0, 0);
        for (int i = 0; i < list.length; ) {
            int j = i + 1;
            while (j < list.length && list[j] > list[j - 1]) j++;
            int shift = 31 - Integer.numberOfLeadingZeros(Math.max(1, list[j - 1] / (j - i)));
            out.put(j - i, 18);
            out.put(shift, 5);
            for (int last = -1; i < j; last = list[i++]) {
                int gap = list[i] - last - 1;
                for (int q = gap >>> shift; q > 0; q--) out.put(1, 1);
                out.put(0, 1);
                out.put(gap & (1 << shift) - 1, shift);
            }
        }
        out.flush();
        return java.util.Arrays.copyOf(out.buf, out.at);
    }

    static int[] listed(byte[] x, int at, int end, int n) {
        Bits in = new Bits(x, at, end);
        int[] list = new int[n];
        for (int i = 0; i < n; ) {
            int run = in.get(18), shift = in.get(5);
            if (run == 0 || run > n - i || shift > 17) throw new IllegalArgumentException("the ids of a segment are damaged");
            for (int last = -1, j = i + run; i < j; i++) {
                int q = 0;
                while (in.get(1) == 1) if (++q > NODES >> shift) throw new IllegalArgumentException("the ids of a segment are damaged");
                list[i] = last = last + 1 + (q << shift | in.get(shift));
                if (last >= NODES) throw new IllegalArgumentException("the ids of a segment are damaged");
            }
        }
        return list;
    }

    int next() {
        return at < end ? buf[at++] & 255 : 0;
    }

    int bit(int y, int chance) {
        int range = hi - lo;
        int mid = lo + (range >>> 16) * chance + (((range & 0xffff) * chance) >>> 16);
        if (decoding) y = (code ^ HALF) <= (mid ^ HALF) ? 1 : 0;
        if (y == 1) hi = mid; else lo = mid + 1;
        while (((lo ^ hi) & 0xff000000) == 0) {
            if (decoding) code = code << 8 | next(); else buf[at++] = (byte) (hi >>> 24);
            lo <<= 8;
            hi = hi << 8 | 255;
        }
        return y;
    }

    static void learn(int[] t, int i, int y, int most) {
        int e = t[i], n = e & 1023, p = e >>> 10;
        p += ((y << 22) - p >> 7) * SHARE[n] >> 9;
        if (p > 4194303) p = 4194303;
        t[i] = p << 10 | (n < most ? n + 1 : n);
    }

    // one decision by two contexts: their chances are mixed under weights that follow which did well
    int both(int y, int[] ta, int a, int[] tb, int b, int set, int most) {
        int sa = STRETCH[ta[a] >>> 20], sb = STRETCH[tb[b] >>> 20];
        int wa = weights[2 * set], wb = weights[2 * set + 1];
        int dot = (int) (((long) wa * sa + (long) wb * sb) >> 16);
        if (dot > 2047) dot = 2047; else if (dot < -2047) dot = -2047;
        int chance = SQUASH[dot + 2048];
        y = bit(y, chance);
        int err = (y << 16) - chance;
        weights[2 * set] = wa + (sa * (err >> 2) >> 13);
        weights[2 * set + 1] = wb + (sb * (err >> 2) >> 13);
        learn(ta, a, y, most);
        learn(tb, b, y, 60);
        return y;
    }

    int alone(int y, int[] t, int i) {
        int chance = t[i] >>> 16;
        if (chance < 16) chance = 16; else if (chance > 65520) chance = 65520;
        y = bit(y, chance);
        learn(t, i, y, 1000);
        return y;
    }

    // a number's place in its bin
    int place(int v, int b) {
        if (b < 8) return b;
        int bits = (b >> 2) - 1;
        if (!decoding) plain.put(v & (1 << bits) - 1, bits);
        return decoding ? (4 | b & 3) << bits | plain.get(bits) : v;
    }

    // bin of an id's rank, 0 if it has none
    static int binOf(int x) {
        return x < NODES ? bin(x) : 0;
    }

    // a rank's bin by order 0, first decisions by order 1 too; 0 says that the id has none, and its own bin follows
    int tree(int x, int before) {
        int b = decoding ? 0 : binOf(x), node = 1;
        for (int k = LEVELS - 1; k >= 0; k--) {
            int slot = (before * 0x2545F491 + node * 0x9E3779B1) >>> 16;
            node = node << 1 | (k >= LEVELS - MIXED ? both(b >>> k & 1, top, node, one, slot, k, 1000) : alone(b >>> k & 1, top, node));
        }
        b = node & (1 << LEVELS) - 1;
        if (b > 0) {
            x = place(x, b);
            if (x > ranks) throw new IllegalArgumentException("a block of a segment is damaged");
            return x;
        }
        b = decoding ? 0 : bin(x - NODES);
        node = 1;
        for (int k = LEVELS; k >= 0; k--) node = node << 1 | alone(b >>> k & 1, rare, node);
        x = place(x - NODES, node & (2 << LEVELS) - 1);
        if (x < 0 || x >= NODES) throw new IllegalArgumentException("a block of a segment is damaged");
        return NODES + x;
    }

    // ids of a table's entry that was right (conf up) or wrong (down, then replaced)
    static int seen(int e, int x) {
        if (e != 0 && (e >>> 4) - 1 == x) return (e & 15) < 15 ? e + 1 : e;
        return (e & 15) < 2 ? x + 1 << 4 : e - 2;
    }

    // of ids as ranks from 1, or NODES plus an id without one
    void run(int[] ids, int from, int to) {
        int a = 0, b = 0;
        for (int i = from; i < to; i++) {
            int x = ids[i];
            if (!decoding && at + 32 > buf.length) buf = java.util.Arrays.copyOf(buf, 2 * buf.length);
            int h1 = a * 0x9E3779B1 >>> 17, h2 = (a * 0x2545F491 + b * 0x9E3779B1 ^ a >>> 3) >>> 17;
            int e1 = first[h1], e2 = second[h2];
            int c1 = (e1 >>> 4) - 1, c2 = (e2 >>> 4) - 1, k1 = e1 & 15, k2 = e2 & 15;
            int got = -1;
            if (e2 != 0 && both(x == c2 ? 1 : 0, flags, k2 << 6 | binOf(c2), flags, 2048 + (k2 << 2 | (c1 == c2 ? 2 : 0) | (k1 > 3 ? 1 : 0)), 10, 250) == 1) got = c2;
            if (got < 0 && e1 != 0 && (e2 == 0 || c1 != c2) && both(x == c1 ? 1 : 0, flags, 1024 | k1 << 6 | binOf(c1), flags, 2112 + (k1 << 2 | (e2 == 0 ? 0 : k2 < 4 ? 1 : 2)), 11, 250) == 1) got = c1;
            if (got < 0) got = tree(x, a);
            ids[i] = x = got;
            first[h1] = seen(e1, x);
            second[h2] = seen(e2, x);
            b = a;
            a = x;
        }
        if (!decoding) for (int i = 0; i < 4; i++) {
            if (at == buf.length) buf = java.util.Arrays.copyOf(buf, at + 64);
            buf[at++] = (byte) (lo >>> 24);
            lo = lo << 8 | 255;
        }
    }

    static int int4(byte[] x, int i) {
        return x[i] & 255 | (x[i + 1] & 255) << 8 | (x[i + 2] & 255) << 16 | (x[i + 3] & 255) << 24;
    }

    static void put4(byte[] x, int i, int v) {
        x[i] = (byte) v;
        x[i + 1] = (byte) (v >>> 8);
        x[i + 2] = (byte) (v >>> 16);
        x[i + 3] = (byte) (v >>> 24);
    }

    static long long8(byte[] x, int i) {
        return int4(x, i) & 0xffffffffL | (long) int4(x, i + 4) << 32;
    }

    static int crc(byte[] x, int from, int n) {
        java.util.zip.CRC32 c = new java.util.zip.CRC32();
        c.update(x, from, n);
        return (int) c.getValue();
    }

    // code section: ids, ids of a block, ids of the list and its bytes; code's bytes, plain bytes and checksum
    // of each block; then the list, and each block's code and plain bits
    static byte[] encode(byte[] raw, int size) {
        int n = raw.length / 4, blocks = (n + size - 1) / size;
        int[] ids = new int[n];
        for (int i = 0; i < n; i++) {
            ids[i] = int4(raw, 4 * i);
            if (ids[i] < 0 || ids[i] >= NODES) throw new IllegalArgumentException("ids of 17 bits at most");
        }
        int[] list = ranked(ids), rank = new int[NODES];
        for (int i = 0; i < list.length; i++) rank[list[i]] = i + 1;
        for (int i = 0; i < n; i++) ids[i] = rank[ids[i]] > 0 ? rank[ids[i]] : NODES + ids[i];
        byte[] table = written(list);
        int at = 16 + 12 * blocks + table.length;
        byte[] out = new byte[at + 2 * n + 64];
        put4(out, 0, n);
        put4(out, 4, size);
        put4(out, 8, list.length);
        put4(out, 12, table.length);
        System.arraycopy(table, 0, out, 16 + 12 * blocks, table.length);
        Bits plain = new Bits(new byte[2 * Math.min(n, size) + 64], 0, 0);
        for (int k = 0; k < blocks; k++) {
            int from = k * size, to = Math.min(n, from + size);
            plain.at = 0;
            CoderVERSION c = new CoderVERSION(false, out, at, out.length, list.length, plain);
            c.run(ids, from, to);
            plain.flush();
            out = c.buf;
            if (c.at + plain.at > out.length) out = java.util.Arrays.copyOf(out, 2 * (c.at + plain.at));
            System.arraycopy(plain.buf, 0, out, c.at, plain.at);
            put4(out, 16 + 12 * k, c.at - at);
            put4(out, 20 + 12 * k, plain.at);
            put4(out, 24 + 12 * k, crc(raw, 4 * from, 4 * (to - from)));
            at = c.at + plain.at;
        }
        return java.util.Arrays.copyOf(out, at);
    }

    static byte[] decode(byte[] x, int begin) {
        if (x.length < begin + 16) throw new IllegalArgumentException("a segment is cut off");
        int n = int4(x, begin), size = int4(x, begin + 4), listed = int4(x, begin + 8), table = int4(x, begin + 12);
        if (n < 0 || size <= 0 || listed < 0 || listed >= NODES || table < 0) throw new IllegalArgumentException("a segment's counts are damaged");
        int blocks = (n + size - 1) / size, at = begin + 16 + 12 * blocks;
        if (x.length - table < at) throw new IllegalArgumentException("a segment is cut off");
        int[] list = listed(x, at, at + table, listed);
        at += table;
        byte[] out = new byte[4 * n];
        int[] ids = new int[n];
        for (int k = 0; k < blocks; k++) {
            int from = k * size, to = Math.min(n, from + size), mid = at + int4(x, begin + 16 + 12 * k), end = mid + int4(x, begin + 20 + 12 * k);
            if (mid < at || end < mid || end > x.length) throw new IllegalArgumentException("block " + k + " of a segment is damaged");
            new CoderVERSION(true, x, at, mid, listed, new Bits(x, mid, end)).run(ids, from, to);
            for (int i = from; i < to; i++) put4(out, 4 * i, ids[i] < NODES ? list[ids[i] - 1] : ids[i] - NODES);
            if (crc(out, 4 * from, 4 * (to - from)) != int4(x, begin + 24 + 12 * k)) throw new IllegalArgumentException("block " + k + " of a segment is damaged");
            at = end;
        }
        return out;
    }

    // where the code section of a segment begins: after magic, counts, checksum and the index of documents
    static int code(byte[] x) {
        if (x.length < 28 || int4(x, 0) != 0x49544C47 || int4(x, 4) != 0x33) throw new IllegalArgumentException("no segment of token ids");
        long docs = long8(x, 8);
        if (docs < 0 || 28 + 12 * docs > x.length || crc(x, 28, (int) (12 * docs)) != int4(x, 24)) throw new IllegalArgumentException("the index of a segment is damaged");
        return (int) (28 + 12 * docs);
    }
}

public final class EncodeVERSION implements org.apache.spark.sql.api.java.UDF2 {
    public Object call(Object ids, Object size) {
        return ids == null ? null : CoderVERSION.encode((byte[]) ids, ((Integer) size).intValue());
    }
}

public final class IdsVERSION implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object x) {
        return x == null ? null : CoderVERSION.decode((byte[]) x, CoderVERSION.code((byte[]) x));
    }
}

public final class DocsVERSION implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object in) {
        if (in == null) return null;
        byte[] x = (byte[]) in, ids = CoderVERSION.decode(x, CoderVERSION.code(x));
        int docs = (int) CoderVERSION.long8(x, 8);
        long at = CoderVERSION.long8(x, 16);
        long[] out = new long[4 * docs];
        int i = 0;
        for (int d = 0; d < docs; d++) {
            int n = CoderVERSION.int4(x, 28 + 8 * docs + 4 * d);
            out[4 * d] = CoderVERSION.long8(x, 28 + 8 * d);
            out[4 * d + 1] = at;
            out[4 * d + 2] = n;
            out[4 * d + 3] = CoderVERSION.crc(ids, 4 * i, 4 * n) & 0xffffffffL;
            i += n;
            at += n;
        }
        if (4 * i != ids.length) throw new IllegalArgumentException("a segment's index doesn't fit its ids");
        return out;
    }
}
"""
FUNCTIONS = {
    "gridloom_encode_ids": ("gridloom.vVERSION.EncodeVERSION", "binary"),
    "gridloom_read_ids": ("gridloom.vVERSION.IdsVERSION", "binary"),
    "gridloom_read_docs": ("gridloom.vVERSION.DocsVERSION", "array<long>"),
}
