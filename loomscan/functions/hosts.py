"""Forms of host names as SQL text: numbers of IPv4, groups of IPv6, punycode; after the WHATWG URL rules.

Text, and not columns, since a lambda that is parsed once costs a session far less than
one that is built call by call.  Names map to lower case and full-width dots to dots;
further mappings of characters aren't made.
"""

from __future__ import annotations


def let(value: str, name: str, body: str) -> str:
    """body, in which name stands for value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_DIGIT = "substr('abcdefghijklmnopqrstuvwxyz0123456789', cast({} as int) + 1, 1)"


def _varint(delta: str, bias: str) -> str:
    """delta in generalised variable-length digits; 32-bit values take seven at most."""
    threshold = f"least(26, greatest(1, 36 * j - {bias}))"
    more = f"named_struct('q', (a.q - t) div (36 - t), 'out', concat(a.out, {_DIGIT.format('t + (a.q - t) % (36 - t)')}), 'done', false)"
    last = f"named_struct('q', a.q, 'out', concat(a.out, {_DIGIT.format('a.q')}), 'done', true)"
    step = let(threshold, "t", f"if(a.done, a, if(a.q < t, {last}, {more}))")
    return f"aggregate(sequence(1, 8), named_struct('q', cast({delta} as bigint), 'out', '', 'done', false), (a, j) -> {step}, a -> a.out)"


def _adapted(delta: str, points: str, first: str) -> str:
    begin = let(f"if({first}, {delta} div 700, {delta} div 2)", "d", f"d + d div {points}")
    return f"aggregate(sequence(1, 6), named_struct('d', {begin}, 'k', 0), (a, j) -> if(a.d > 455, named_struct('d', a.d div 35, 'k', a.k + 36), a), a -> cast(a.k + (36 * a.d) div (a.d + 38) as bigint))"


def punycode(label: str) -> str:
    """A label with its characters beyond ASCII as what is put in between the others."""
    # The others' characters, and each further one by its code and place.
    less = lambda top, low, high: f"size(filter(slice(s.c, {low} + 1, {high} - ({low})), z -> z < {top}))"
    again = less("p.c", "o.at + 1", "p.i")
    further = f"if(o.at < 0, 0, {less('o.n', 'o.at + 1', 'size(s.c)')} + 1) + (p.c - o.n - if(o.at < 0, 0, 1)) * (o.h + 1) + {less('p.c', '0', 'p.i')}"
    delta = f"cast(if(o.at >= 0 and p.c = o.n, {again}, {further}) as bigint)"
    step = let(delta, "d", f"named_struct('n', p.c, 'at', p.i, 'h', o.h + 1, 'bias', {_adapted('d', '(o.h + 1)', 'o.first')}, 'first', false, 'out', concat(o.out, {_varint('d', 'o.bias')}))")
    start = "named_struct('n', 128, 'at', -1, 'h', cast(size(filter(s.c, z -> z < 128)) as bigint), 'bias', cast(72 as bigint), 'first', true, 'out', '')"
    rest = f"aggregate(array_sort(filter(transform(s.c, (z, i) -> named_struct('c', z, 'i', i)), z -> z.c >= 128)), {start}, (o, p) -> {step}, o -> o.out)"
    basic = r"regexp_replace(s.l, r'[^\x00-\x7F]', '')"
    whole = f"concat('xn--', {basic}, if({basic} = '', '', '-'), {rest})"
    return let(f"named_struct('l', {label}, 'c', transform(split({label}, ''), z -> ascii(z)))", "s", whole)


def ipv4(name: str) -> str:
    """Up to four decimal, octal or hexadecimal numbers as four decimal ones; null if they aren't such."""
    number = "case when x rlike '^0x' then coalesce(cast(conv(nullif(substr(x, 3), ''), 16, 10) as bigint), 0L) when x rlike '^0.' then cast(conv(x, 8, 10) as bigint) else cast(x as bigint) end"
    # Without leading zeros no number of more digits than these fits into 32 bits.
    fine = r"x rlike r'^(0x0*[0-9a-f]{0,8}|0[0-7]{0,11}|0+[0-7]{1,11}|[1-9][0-9]{0,9})$'"
    valid = "forall(slice(v, 1, size(v) - 1), x -> x < 256) and v[size(v) - 1] < cast(power(256, 5 - size(v)) as bigint)"
    total = "aggregate(transform(v, (x, i) -> if(i = size(v) - 1, x, x * cast(power(256, 3 - i) as bigint))), 0L, (a, b) -> a + b)"
    spelled = let(total, "w", "concat_ws('.', cast(w div 16777216 as string), cast(w div 65536 % 256 as string), cast(w div 256 % 256 as string), cast(w % 256 as string))")
    numbers = f"if(size(q) <= 4 and forall(q, x -> {fine}), {let(f'transform(q, x -> {number})', 'v', f'if({valid}, {spelled}, null)')}, null)"
    return let(rf"split(regexp_replace({name}, r'[.]$', ''), r'[.]')", "q", numbers)


def ipv6(inner: str) -> str:
    """Eight groups in their shortest form, the longest run of zeros left out; null if they aren't such."""
    pair = lambda i: f"lower(hex(cast(regexp_extract(g, r'([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)$', {i}) as bigint) * 256 + cast(regexp_extract(g, r'([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)$', {i + 1}) as bigint)))"
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tailed = rf"if(g rlike r':{part}([.]{part}){{3}}$', concat(regexp_replace(g, r'[0-9.]+$', ''), {pair(1)}, ':', {pair(3)}), g)"
    side = lambda i: f"if(coalesce(get(e, {i}), '') = '', cast(array() as array<string>), split(e[{i}], ':'))"
    both = let(f"named_struct('a', {side(0)}, 'b', {side(1)}, 'n', size(e))", "s", "case s.n when 1 then s.a when 2 then if(size(s.a) + size(s.b) <= 7, concat(s.a, array_repeat('0', 8 - size(s.a) - size(s.b)), s.b), null) end")
    shortest = "j"
    for k in range(2, 9):  # the longest run is asked for first
        one = rf"(?<![0-9a-f])0(?::0){{{k - 1}}}(?![0-9a-f])"
        shortest = rf"if(j rlike r'{one}', regexp_replace(regexp_replace(j, r'^(.*?){one}(.*)$', '$1::$2'), ':{{3,}}', '::'), {shortest})"
    joined = let("array_join(transform(m, x -> regexp_replace(x, '^0+(?=.)', '')), ':')", "j", shortest)
    groups = let(both, "m", f"if(size(m) = 8 and forall(m, x -> x rlike '^[0-9a-f]{{1,4}}$'), {joined}, null)")
    return let(inner, "g", let(tailed, "f", let("split(f, '::')", "e", groups)))


def host(name: str) -> str:
    """A lower-case host without its port as it is written in an address; null if it is no host."""
    simple = r"h rlike r'^[a-z0-9_~!$&()*+,;=.-]+$' and not h rlike r'(^|[.])(0x[0-9a-f]*|[0-9]+)[.]?$'"
    plain = r"if(h rlike '%', coalesce(try_url_decode(replace(h, '+', '%2B')), h), h)"
    labels = rf"array_join(transform(split(lower(translate({plain}, '。．｡', '...')), r'[.]'), l -> if(l rlike r'[^\x00-\x7F]', {punycode('l')}, l)), '.')"
    forbidden = r"d = '' or d rlike r'[\x00-\x20#%/:<>?@\[\\\]^|\x7F]'"
    named = let(labels, "d", f"case when {forbidden} then null when d rlike r'(^|[.])(0x[0-9a-f]*|[0-9]+)[.]?$' then {ipv4('d')} else d end")
    six = rf"concat('[', {ipv6(r'substr(h, 2, length(h) - 2)')}, ']')"
    return let(name, "h", rf"case when {simple} then h when h rlike r'^\[.*\]$' then {six} else {named} end")
