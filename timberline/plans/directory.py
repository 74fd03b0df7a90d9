"""The directory of known problems: rules as data, their evaluation over issues and exception types, search and export.

A rule's patterns are alternatives over lower-case text, evaluated as one. An issue meets a rule by its pattern, title, exception type and
file name, or, where those say nothing, by its samples. A rule that no issue meets may still be met by an exception type.

Defined results: no issues and no exception types give no matches. Null titles, types and samples count as empty. Issues
that meet several rules count for each. Rules in ``rules`` can be a user's own, in the form of ``RULES``.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.patterns import meets
from timberline.functions.sqltext import Sql, X
from timberline.functions.text import csv_cell
from timberline.plans.advice import ADVICE

# Categories and their labels.
CATEGORIES = {
    "runtime-crash": "Runtime & crashes", "memory": "Memory & resources", "concurrency": "Concurrency & threading", "network": "Network & connectivity",
    "database": "Database", "http-api": "HTTP & API", "security": "Security & auth", "data-integrity": "Data integrity",
    "configuration": "Configuration & environment", "performance": "Performance", "dependencies": "Dependencies & versions",
    "queue-backlog": "Queues & backpressure", "caching": "Caching", "external-services": "External services",
    "container-runtime": "Containers & orchestration", "business-rules": "Business rules", "i18n-encoding": "Encoding, locale & time zones",
    "scheduling": "Scheduling & background jobs", "observability": "Logging hygiene",
}
# Fixed values: (id, category, severity, title, languages, patterns) of the known problems.
RULES = (
    (
        "null-reference", "runtime-crash", "critical", "Null / undefined dereference", ("java", "kotlin", "javascript", "typescript", "python", "c#"),
        ("nullpointerexception", "nullreferenceexception", "cannot read propert", "is not iterable", "undefined is not", "cannot access .* before initialization", r"typeerror\b", r"\bkeyerror\b", "segmentation fault"),
    ),
    (
        "index-out-of-range", "runtime-crash", "critical", "Index out of range / off-by-one", ("go", "python", "java", "javascript", "c", "rust"),
        ("index out of range", "out of bounds", "indexerror", "arrayindexoutofboundsexception", "boundserror"),
    ),
    (
        "panic-abort", "runtime-crash", "critical", "Process crash / panic / abort", ("go", "c", "c++", "rust", "native"),
        ("panic:", "fatal error", "core dumped", "sigsegv", "sigabrt", r"abort\(\)", "assertionerror", "assertion failed"),
    ),
    (
        "unhandled-exception", "runtime-crash", "critical", "Unhandled exception escaping a handler", ("javascript", "typescript", "python", "java", "go"),
        ("unhandled ?(exception|rejection|promise)", "uncaught (exception|error)", "unhandledpromiserejection", "exception in thread"),
    ),
    (
        "out-of-memory", "memory", "critical", "Out of memory / heap exhaustion", ("java", "node", "python", "go", "dotnet"),
        ("out of memory", "outofmemoryerror", "heap space", "memoryerror", "javascript heap out of memory", "cannot allocate memory", "oom[- ]?kill"),
    ),
    (
        "gc-pressure", "memory", "warning", "GC pressure / stop-the-world", ("java", "go", "dotnet", "node"),
        ("gc overhead limit", "pause.*full.*gc", "stop.the.world", "concurrent mode failure", "allocation failure"),
    ),
    (
        "resource-limits", "memory", "warning", "File descriptors, threads or quota exhausted", ("java", "node", "python", "unix"),
        ("too many open files", "emfile", "cannot allocate memory", "thread pool (exhausted|is full)", "rejectedexecutionexception", "quota exceeded", "no space left on device", "enospc", "resource temporarily unavailable"),
    ),
    (
        "deadlock", "concurrency", "critical", "Deadlock / lock contention", ("java", "go", "sql", "dotnet"),
        ("deadlock", "lock wait timeout", "serializationfailure", "could not obtain lock"),
    ),
    (
        "race-condition", "concurrency", "warning", "Race condition / thread safety", ("java", "go", "python", "javascript"),
        ("concurrentmodificationexception", "race (condition|detected)", "data race", "not thread.safe", "illegalstateexception"),
    ),
    (
        "timeout", "network", "critical", "Timeout / deadline exceeded", ("any",),
        ("timed out", "timeout", "etimedout", "esockettimedout", "deadlineexceeded", "read timed", "context deadline"),
    ),
    (
        "connection-refused", "network", "critical", "Connection refused / reset / broken pipe", ("any",),
        ("econnrefused", "connection refused", "econnreset", "connection reset", "broken pipe", r"\bepipe\b", "ehostunreach", "enetunreach", "no route to host"),
    ),
    (
        "dns-tls", "network", "warning", "DNS resolution and TLS failures", ("any",),
        ("enotfound", "eai_again", "getaddrinfo", "name resolution", "certificate (verify|has expired|is not valid|expired|not yet valid)", "cert(?:ificate)? verify", "self signed", "unable to verify", "ssl handshake", r"\bcert_", "tlsv1 alert"),
    ),
    (
        "db-constraint", "database", "critical", "Constraint and integrity violations", ("sql", "any"),
        ("unique (constraint|key|violation)", "duplicate key", "foreign key", "integrityerror", "violates (foreign key|unique)", "not null constraint", "23505", "23503"),
    ),
    (
        "db-timeout", "database", "critical", "Database query timeout / slow query", ("sql", "any"),
        ("statement cancelled due to (timeout|statement timeout)", "querytimeout", "lock wait timeout", "canceling statement", "too many connections", "connection pool", "connection is closed"),
    ),
    (
        "db-unavailable", "database", "critical", "Database unavailable or replication lag", ("sql", "any"),
        ("database (is )?(unavailable|not available)", "could not connect to server", "server closed the connection", "read-only transaction", "replication", "failover"),
    ),
    (
        "http-5xx", "http-api", "critical", "HTTP 5xx — server-side failures", ("any",),
        (r"(?:status(?:_?code)?|responded with|responde?d|http)\D{0,14}5\d\d\b", r"\b(?:get|post|put|patch|delete|head|options)\s+\S+\s*(?:->|=>)\s*5\d\d\b", "\" 5\\d\\d(?: |$)", " 5\\d\\d \\d+ \"", r"\b5\d\d\b (?:internal|error|server|bad|service|gateway)", "internal server error", "bad gateway", "service unavailable", "gateway time-?out"),
    ),
    (
        "http-4xx", "http-api", "warning", "HTTP 4xx — client errors", ("any",),
        (r"(?:status(?:_?code)?|responded with|responde?d|http)\D{0,14}4\d\d\b", r"\b(?:get|post|put|patch|delete|head|options)\s+\S+\s*(?:->|=>)\s*4\d\d\b", "\" 4\\d\\d(?: |$)", " 4\\d\\d \\d+ \"", r"\b4\d\d\b (?:bad|not found|unauthorized|forbidden|unprocessable|conflict|client)", "not found", "unprocessable entity"),
    ),
    (
        "rate-limit", "http-api", "warning", "Rate limiting / throttling (429)", ("any",),
        (r"\b429\b", "rate limit", "throttl", "too many requests", "quota exceeded", "retry-after"),
    ),
    (
        "auth-failure", "security", "warning", "Authentication and authorization failures", ("any",),
        ("unauthorized", "forbidden", "authentication fail", "invalid (credentials|password|token|user)", "token expired", "jwt", "signature has expired", "permission denied", "access denied", "failed password", "invalid user", r"(?:status(?:_?code)?|responded with)\D{0,14}40[13]\b"),
    ),
    (
        "injection", "security", "critical", "Injection / path traversal / SSRF", ("sql", "shell", "any"),
        ("sql injection", r"\.\./", "path traversal", "ssrf", "command injection", "injection detected", "nosql injection"),
    ),
    (
        "corruption", "data-integrity", "critical", "Corruption, truncation or checksum mismatch", ("any",),
        ("corrupt", "checksum mismatch", "unexpected eof", "truncated", "bad signature", "malformed", "invalid (json|utf-?8|packet)"),
    ),
    (
        "deserialization", "data-integrity", "warning", "Deserialization failure / bad payload", ("java", "python", "javascript"),
        ("cannot deserialize", "unexpected token", "jsonparseexception", "malformed (message|argument)", "invalidpayload", "typeerror:.*(object|property)"),
    ),
    (
        "config-missing", "configuration", "critical", "Missing or invalid configuration", ("any",),
        ("config(uration)? (not )?(found|missing|invalid)", "missing required (environment )?variable", "unresolved placeholder", "could not resolve (host|url|address)", "unknown option", "invalid (value|option|argument)"),
    ),
    (
        "env-drift", "configuration", "info", "Environment/version drift", ("any",),
        ("deprecat", "will be removed", "no longer supported", "end of life", "version mismatch", "legacy (api|endpoint|mode)"),
    ),
    (
        "slow-operation", "performance", "warning", "Slow operation / latency overrun", ("any",),
        (r"took \d+ ?ms", "elapsed", "slow (query|request|operation)", "latency exceeded", "degraded", r"took \d+(\.\d+)? ?(seconds|sec|s)\b"),
    ),
    (
        "cpu-hot", "performance", "warning", "CPU saturation / GC-bound loop", ("any",),
        ("high (cpu )?load", "cpu (usage|throttl)", "re-?executed.*loop", "busy loop", "throttled"),
    ),
    (
        "dependency-conflict", "dependencies", "warning", "Dependency version conflict", ("node", "python", "java", "dotnet"),
        ("peer dep", "npm err", "requires a peer of", "incompatible (version|api)", "no matching (version|distribution)", "could not find a version", "dependency resolution"),
    ),
    (
        "schema-mismatch", "dependencies", "warning", "Contract / schema mismatch", ("any",),
        ("unknown field", "unrecognized field", "additional propert", "missing required property", "invalid schema", "contract mismatch"),
    ),
    (
        "stack-overflow", "runtime-crash", "critical", "Stack overflow / runaway recursion", ("java", "javascript", "python", "c#", "go", "rust"),
        ("stack ?overflow", "stackoverflowerror", "maximum call stack size exceeded", "recursion (error|limit)"),
    ),
    (
        "class-cast", "runtime-crash", "critical", "Class cast / type mismatch", ("java", "c#", "python"),
        ("class ?cast ?exception", "cannot be cast to", "invalidcastexception", "is not an instance of", "expected .* got .*"),
    ),
    (
        "illegal-argument", "runtime-crash", "warning", "Illegal argument / precondition failed", ("java", "rust", "python", "go", "c"),
        ("illegalargument", "illegal argument", "argument(?:s)? (?:must|should|has to) be", "precondition (?:failed|not met)", "value out of (?:range|domain)", "invalid (?:argument|parameter) .*:"),
    ),
    (
        "arithmetic-error", "runtime-crash", "warning", "Division by zero / arithmetic failure", ("java", "python", "go", "c", "rust", "javascript"),
        ("division by zero", "zerodivisionerror", "arithmetic ?exception", "divide by zero", "modulo by zero"),
    ),
    (
        "resource-closed", "runtime-crash", "critical", "Use after close / released resource", ("java", "c#", "python", "go"),
        ("stream is closed", "closed channel", "connection is closed", "object has been closed", "use after (close|free|dispose)", "i/o exception.*closed"),
    ),
    (
        "memory-leak", "memory", "warning", "Memory leak / unbounded growth", ("java", "javascript", "python", "go", "c#", "ruby"),
        ("memory leak", "heap (?:is )?(?:growing|growth)", "retained (?:size|memory)", "cache (?:size|entries) (?:grew|exceeded|limit)", "memory usage (?:grew|is growing|increased)", r"evicted \d+ entries"),
    ),
    (
        "metaspace", "memory", "warning", "Metaspace / class-loading exhaustion", ("java", "jvm"),
        ("metaspace", "class ?loader.*(leak|error)", "outofmemoryerror: metaspace", "unable to load class", "classnotfoundexception"),
    ),
    (
        "buffer-overflow", "memory", "critical", "Buffer overrun / native bounds violation", ("c", "c++", "rust", "go", "native"),
        ("buffer (?:overflow|overrun)", "stack smashing detected", "heap-buffer-overflow", "out of bounds (?:write|read)", "corrupted (?:size|top|double linked)"),
    ),
    (
        "thread-interrupted", "concurrency", "warning", "Thread interrupted / cancelled mid-work", ("java", "python", "go", "c#"),
        ("interruptedexception", "thread interrupted", "task (?:was )?cancel(?:led|ed)", "operation (?:was )?cancell?ed", "context canceled", "execution (?:was )?interrupted"),
    ),
    (
        "atomicity-violation", "concurrency", "critical", "Lost update / non-atomic read-modify-write", ("java", "python", "go", "c#", "javascript", "node"),
        ("lost update", "concurrent modification", "atomicity", "read-?modify-?write", "optimistic lock.*(fail|exception)", "version mismatch.*update"),
    ),
    (
        "semaphore-permit", "concurrency", "warning", "Permit / capacity limit reached", ("java", "go", "c#", "node"),
        ("no permits available", "semaphore", r"acquire\(\) (?:failed|interrupted)", "concurrency limit", "max concurrency", "too many concurrent"),
    ),
    (
        "proxy-failure", "network", "warning", "Proxy or gateway failure", ("any",),
        ("proxy (?:error|failed|failure)", "bad gateway", "gateway timeout", "upstream (?:sent invalid|prematurely closed|reset)", "no route to host through proxy", "tunneling socket could not be established"),
    ),
    (
        "url-parse-error", "network", "warning", "Malformed URL or host", ("any",),
        ("malformed ?url", "invalid ?url", "url ?parse", "unknown url ?scheme", "unsupported ?scheme", "no host ?(given|specified)", "illegal character in (?:url|host)"),
    ),
    (
        "http2-protocol", "network", "warning", "HTTP/2 or protocol-level stream error", ("java", "go", "node", "c#"),
        ("goaway", "stream (?:error|closed|reset)", "rst_stream", "http2 protocol error", "connection error.*http/2", "refused stream"),
    ),
    (
        "replication-lag", "database", "warning", "Replication lag / stale replica reads", ("sql", "mysql", "postgres", "mongodb", "dynamodb"),
        ("replication lag", "replica (?:is )?(?:behind|stale|lagging)", "read ?after ?write", "eventual(?:ly)? consistent", "follower (?:is )?behind", "slave (?:is )?behind"),
    ),
    (
        "connection-dropped", "database", "critical", "Database connection dropped mid-query", ("sql", "mysql", "postgres", "mongodb"),
        ("connection (?:was )?(?:closed|reset|dropped|terminated)", "server has gone away", "broken (?:mysql )?connection", "connection reset by peer", "no connection to the server", "socket (?:exception )?on (?:read|write)"),
    ),
    (
        "transaction-rollback", "database", "warning", "Transaction rolled back / aborted", ("sql", "postgres", "mysql", "mongodb"),
        ("transaction (?:was )?(?:rolled back|aborted|cancelled)", "rollback(?:ed)?(?: due to| because)", "current transaction is aborted", "savepoint", "atomicity violation"),
    ),
    (
        "db-migration", "database", "critical", "Schema migration mismatch", ("sql", "flyway", "liquibase", "prisma", "django"),
        ("relation \"?\\w+\"? does not exist", "column .* does not exist", "unknown column", "migration (?:failed|checksum mismatch|not applied)", "table .* (?:already exists|not found)", "flyway", "liquibase"),
    ),
    (
        "query-plan-regression", "database", "warning", "Slow query / missing index", ("sql", "any"),
        ("slow query", r"query (?:took|exceeded) \d{3,}", "execution plan", "seq scan", "sequential scan", "using filesort", "using temporary", "index (?:is )?(?:missing|not used|unused)"),
    ),
    (
        "payload-too-large", "http-api", "warning", "Payload too large", ("any",),
        ("payload too large", "request entity too large", r"(?:status(?:_?code)?|responded with)\D{0,14}413\b", "\" 413(?: |$)", "request body.*exceeds", "maximum (?:upload|request) size", "body size .* limit"),
    ),
    (
        "validation-error", "http-api", "info", "Input validation failure", ("any",),
        ("validation (?:failed|error)", "invalid (?:request|parameter|argument|payload)", r"(?:status(?:_?code)?|responded with|responde?d)\D{0,14}400\b", "\" 400(?: |$)", "missing required (?:field|parameter)", "does not match the (?:required )?pattern", "failed to (?:convert|parse) (?:request|parameter)"),
    ),
    (
        "unsupported-media", "http-api", "warning", "Unsupported media type / encoding", ("any",),
        ("unsupported media type", r"(?:status(?:_?code)?|responded with)\D{0,14}415\b", "\" 415(?: |$)", "content[- ]type .* (?:not supported|unsupported)", "unsupported ?charset", "cannot (?:decode|parse) content[- ]?type", "malformed multipart"),
    ),
    (
        "gateway-timeout", "http-api", "critical", "Gateway timeout / request deadline exceeded", ("any",),
        (r"(?:status(?:_?code)?|responded with)\D{0,14}504\b", "\" 504(?: |$)", "gateway time-?out", "upstream timed out", "deadline exceeded", "request timed out.*proxy", "no healthy upstream"),
    ),
    (
        "not-implemented", "http-api", "info", "Not implemented / unsupported operation", ("any",),
        ("not implemented", r"(?:status(?:_?code)?|responded with)\D{0,14}501\b", "\" 501(?: |$)", "unsupported operation", "todo:? ", "unimplemented", "this endpoint is a stub"),
    ),
    (
        "cors", "http-api", "warning", "CORS / preflight rejection", ("any",),
        ("cors", "access-control-allow-origin", "preflight", "blocked by cors policy", "origin .* not allowed"),
    ),
    (
        "path-traversal", "security", "critical", "Path traversal attempt", ("any",),
        ("path traversal", r"\.\./", "directory traversal", "outside the (?:allowed )?(?:root|base) ?(?:dir|directory)", r"invalid file path.*\.\."),
    ),
    (
        "ssrf", "security", "critical", "Server-side request forgery", ("any",),
        ("ssrf", "server-side request forgery", "blocked (?:private|internal|metadata) (?:address|url|host)", r"169\.254\.169\.254", "request to (?:internal|private) (?:host|address) blocked"),
    ),
    (
        "weak-crypto", "security", "warning", "Weak or disallowed cryptography", ("any",),
        ("weak (?:cipher|algorithm|hash)", "insecure (?:cipher|algorithm)", "md5", "sha1", r"des\b", r"rc4\b", "ecb mode", "disabled (?:cipher|protocol)", "no cipher suites in common"),
    ),
    (
        "insecure-transport", "security", "critical", "Plaintext credential transport", ("any",),
        ("insecure (?:transport|connection)", "plain ?text (?:connection|password|credential)", "credentials sent in plain", "http://.*(?:login|auth|token)", "no tls", "no ssl.*internal"),
    ),
    (
        "log-injection", "security", "warning", "Log forging / control characters", ("any",),
        ("log injection", "log forging", "crlf (?:in|injection)", "newline in (?:header|parameter|value)", "null byte in"),
    ),
    (
        "data-loss", "data-integrity", "critical", "Data loss / missing records", ("any",),
        ("data loss", "(?:records?|rows?|documents?|messages?) (?:were |was )?(?:lost|dropped|deleted|missing)", r"expected \d+ .*(?:got|found) \d+", "count mismatch", "missing (?:records?|rows?|documents?|keys?)", "silent(?:ly)? (?:lost|dropped)"),
    ),
    (
        "numeric-precision", "data-integrity", "warning", "Floating-point / rounding error", ("any",),
        ("floating ?point", "rounding error", "decimal ?(?:mismatch|overflow)", "precision (?:loss|error)", "binary ?float", "bigdecimal"),
    ),
    (
        "state-machine", "data-integrity", "warning", "Invalid state transition", ("any",),
        ("invalid (?:state|status) transition", "cannot (?:transition|move).*to status", "unexpected status", "illegal state", "transition .* not allowed", "already (?:completed|cancelled|shipped|closed)"),
    ),
    (
        "queue-unavailable", "queue-backlog", "critical", "Message broker unavailable", ("kafka", "rabbitmq", "sqs", "node", "java", "python"),
        ("broker (?:is )?(?:not )?(?:available|unreachable|down)", r"(?:kafka|rabbitmq|activemq)[^\n]*?(?:connection refused|timed out)", "no brokers available", "queue (?:is )?(?:unavailable|unreachable)", "topic (?:not found|does not exist|unavailable)", "503 service unavailable.*(?:broker|queue|mq)"),
    ),
    (
        "queue-full", "queue-backlog", "critical", "Queue full / rejected message", ("kafka", "rabbitmq", "sqs", "node", "java"),
        ("queue (?:is )?full", "queue (?:depth|length) (?:exceeded|is too)", "buffer (?:is )?full", "max.?len", "overflow", "overflowed", "message (?:was )?rejected", "publish.*failed.*(?:full|overflow)"),
    ),
    (
        "consumer-lag", "queue-backlog", "warning", "Consumer lag / growing backlog", ("kafka", "rabbitmq", "sqs", "node", "java", "python"),
        ("consumer lag", "(?:group|consumer) (?:is )?(?:behind|lagging)", "offset (?:is )?behind", "backlog (?:is )?(?:growing|increasing)", "oldest (?:unprocessed|message)", "processing is falling behind"),
    ),
    (
        "poison-message", "queue-backlog", "warning", "Poison message / repeatedly failing job", ("kafka", "rabbitmq", "sqs", "node", "java", "python"),
        ("poison (?:message|pill)", "message (?:will be )?discarded", "max(?:imum)? (?:delivery|attempt|retry) (?:count )?exceeded", "dead[- ]letter", r"\bdlq\b", "moving to (?:the )?dead", "retry (?:count|limit) (?:exceeded|reached)"),
    ),
    (
        "offset-reset", "queue-backlog", "warning", "Offset reset / out-of-order processing", ("kafka", "node", "java", "python"),
        ("offset (?:out of range|reset)", "reset(?:ting)? (?:the )?offset", r"auto(?:commit)?\.offset\.reset", "no committed offset", "rebalance(?:ment)? (?:in progress|detected)", "partition (?:re)?assignment"),
    ),
    (
        "cache-stampede", "caching", "warning", "Cache stampede / thundering herd", ("any",),
        ("cache stampede", "thundering herd", "cache dogpile", "cache miss (?:storm|spike|burst)", "many concurrent (?:cache )?misses"),
    ),
    (
        "cache-unavailable", "caching", "warning", "Cache unavailable / eviction pressure", ("redis", "memcached", "any"),
        ("cache (?:is )?(?:unavailable|down|unreachable)", "redis[^n]*connection (?:refused|reset)", "memcached", r"evicted \d+ (?:keys|objects)", "maxmemory", "oom command not allowed", "cache miss ratio"),
    ),
    (
        "stale-cache", "caching", "warning", "Stale cache entry", ("any",),
        ("stale (?:cache|entry|value|data)", "cache (?:entry )?(?:is )?(?:outdated|expired)", "served from cache.*stale", "inconsistent read", "stale-?while-?revalidate"),
    ),
    (
        "cache-penetration", "caching", "info", "Cache penetration / negative caching", ("any",),
        ("cache penetration", "negative cach", "lookup miss for (?:missing|nonexistent)", "repeated miss", "null (?:result )?cached"),
    ),
    (
        "third-party-api", "external-services", "warning", "Third-party API failure", ("any",),
        ("upstream (?:api|service) (?:error|failed)", r"api returned (?:5\d\d|http 5)", "bad response from", "unexpected response (?:from|body)", "vendor api", "third[- ]party (?:api|service) (?:error|failure)"),
    ),
    (
        "email-delivery", "external-services", "warning", "Email / SMTP delivery failure", ("java", "python", "node", "any"),
        ("smtp", "mail(?:gun|chimp|jet|slack)? (?:delivery|send) (?:failed|error)", "could not send (?:mail|email|message)", r"550\b", r"552\b", r"553\b", r"421\b", "message (?:rejected|deferred|bounced)", "undeliver(?:ed|able)"),
    ),
    (
        "object-storage", "external-services", "warning", "Object storage failure", ("s3", "gcs", "azure", "any"),
        ("s3", "gcs", "azure blob", "minio", "object storage", "bucket (?:does not exist|not found|access denied)", "no such bucket", "nosuchkey", "upload failed", "download failed.*(?:bucket|storage)", "presigned ?url (?:expired|invalid)", "signature does not match"),
    ),
    (
        "webhook-delivery", "external-services", "warning", "Webhook delivery failure", ("any",),
        ("webhook (?:delivery|post|call) (?:failed|error)", "callback (?:failed|error|url)", r"http (?:status )?[45]\d\d from subscriber", "subscriber (?:url )?(?:unreachable|rejected)", r"delivery attempt \d+ failed"),
    ),
    (
        "payment-gateway", "external-services", "critical", "Payment gateway failure", ("any",),
        ("payment (?:gateway|provider|declined|failed)", "card (?:declined|not supported)", "charge failed", "chargeback", "psp", "acquirer", "stripe", "paypal", "braintree", "authorization (?:failed|declined)"),
    ),
    (
        "oom-killed", "container-runtime", "critical", "Container OOM-killed", ("docker", "kubernetes", "any"),
        ("oom-?kill", "out of memory: killed", "exit code 137", "container was killed.*memory", r"memory\.limit exceeded"),
    ),
    (
        "crash-loop", "container-runtime", "critical", "Crash loop / restart back-off", ("kubernetes", "docker", "systemd"),
        ("back-?off (?:restarting|failed)", "crashloopbackoff", "restart(?:ing|ed) (?:container|pod)", "exited with (?:code|status) 1", "start request repeated too quickly", "container .*restart"),
    ),
    (
        "image-pull", "container-runtime", "warning", "Image or dependency pull failure", ("kubernetes", "docker", "any"),
        ("failed to pull image", "imagepullbackoff", "errimagepull", "manifest (?:for|image) .*not found", "pull access denied", "unknown: manifest unknown", "repository does not exist"),
    ),
    (
        "probe-failure", "container-runtime", "warning", "Health / readiness probe failure", ("kubernetes", "docker", "any"),
        ("liveness probe failed", "readiness probe failed", "probe timed out", r"unhealthy\b", "health check failed", "too many restarts"),
    ),
    (
        "resource-throttling", "container-runtime", "warning", "CPU throttling / resource limit", ("kubernetes", "docker", "any"),
        ("cfs throttl", "cpu (?:throttled|quota exceeded|limit exceeded)", "out of cpu", "resource (?:limit|quota) (?:exceeded|reached)", "too many open files.*limit", "ephemeral-storage"),
    ),
    (
        "insufficient-balance", "business-rules", "info", "Insufficient balance / quota", ("any",),
        ("insufficient (?:funds|balance|quota|credit)", "balance (?:is )?too low", "limit exceeded", "exceeds (?:the )?(?:available )?limit", "not enough (?:funds|credit|balance)"),
    ),
    (
        "inventory", "business-rules", "warning", "Stock / inventory conflict", ("any",),
        ("out of stock", "insufficient stock", "inventory (?:conflict|mismatch|shortage)", "oversold", "oversell", "sku .* not available", "no items? left"),
    ),
    (
        "duplicate-submission", "business-rules", "warning", "Duplicate submission", ("any",),
        ("duplicate (?:submission|request|payment|order|key)", "already (?:exists|submitted|processed|created)", "idempotency key", "request (?:was )?already (?:handled|received)", "unique constraint.*(?:id|key)"),
    ),
    (
        "mandatory-field", "business-rules", "info", "Mandatory field missing", ("any",),
        ("field .* is required", "missing (?:required )?(?:field|value|parameter)", "must not be (?:null|empty|blank)", "is mandatory", "required property"),
    ),
    (
        "unicode-error", "i18n-encoding", "warning", "Unicode / character-set failure", ("python", "java", "node", "go", "any"),
        ("unicode(encode|decode)?error", "charmap", "codec can't (?:encode|decode)", "illegal byte sequence", "malformed (?:input|byte)", "unknown encoding", "too many bytes in"),
    ),
    (
        "timezone-missing", "i18n-encoding", "warning", "Time-zone or clock conversion problem", ("java", "python", "node", "go", "any"),
        ("nonexistent local time", "ambiguous local time", "zoneinfo", "not a recognized timezone", "invalid time ?zone", "cannot (?:find|load) (?:the )?timezone", "localtime"),
    ),
    (
        "locale-missing", "i18n-encoding", "warning", "Missing locale or message bundle", ("java", "python", "node", "any"),
        ("no message bundle", "messages? not found for locale", "missing (?:translation|resource bundle)", "missinglocale", "unsupportedlocale", "fallback to (?:en|en-us)", "key not found in (?:bundle|translations)"),
    ),
    (
        "job-missed", "scheduling", "warning", "Scheduled job missed / did not run", ("cron", "quartz", "airflow", "node", "java"),
        ("missed (?:run|execution|fire)", "job .* did not run", "cron .*skipped", "misfire", "misfired", "scheduler .* not (?:started|triggered)", "job was skipped"),
    ),
    (
        "job-overlap", "scheduling", "warning", "Overlapping job runs", ("cron", "quartz", "airflow", "node", "java"),
        ("job .* still running", "previous run .* still (?:running|in progress)", "overlapping (?:run|execution)", "concurrent execution (?:of|not allowed)", "already running", "skipping (?:this )?run"),
    ),
    (
        "job-stuck", "scheduling", "critical", "Stuck / hanging job", ("cron", "quartz", "airflow", "node", "java", "any"),
        ("job .* (?:hung|stuck|timed out)", "heartbeat (?:lost|missed)", "deadlock detected", r"stuck for \d+", r"no progress for \d+"),
    ),
    (
        "log-flooding", "observability", "warning", "Log flooding / runaway logging", ("any",),
        ("log(?:ging)? (?:flood|volume|saturation)", "too many log (?:lines|messages|entries)", "high log volume", "logger.*(?:disabled|suppressed).*volume", "dropping log", "sampling"),
    ),
    (
        "error-swallowed", "observability", "warning", "Error swallowed / handled silently", ("any",),
        (r"(?:catch|except)\s*(?:\([^)]*\))?\s*:\s*(?:pass|continue|return)\b", r"ignored?\b.*exception", "suppressing? (?:the )?(?:error|exception)", "error (?:was )?(?:ignored|discarded|dropped)", "best effort.*(?:ignore|skip)", "catchall"),
    ),
    (
        "sampling-loss", "observability", "info", "Log sampling / truncated output", ("any",),
        ("sampl(?:ing|ed) rate", "sampled (?:out|logs)", "truncat(?:ed|ing) (?:log|message|output)", r"\.\.\. \(\d+ more\)", "log rotation", "rotated log", "buffer (?:flushed|full).*drop"),
    ),
    (
        "log-truncation", "observability", "warning", "Incomplete log entry", ("any",),
        ("entry (?:was )?truncated", "message truncated", "truncated entry", "max(?:imum)? (?:line|entry) (?:length|size)", "line too long", "payload too large to log"),
    ),
    (
        "injection-failure", "configuration", "critical", "Dependency injection / bean wiring failure", ("java", "spring", "dotnet"),
        ("no qualifying bean of type", "no such bean definition", "bean creation (?:failed|exception)", "unsatisfied dependency", "cannot resolve (?:parameter|dependency)", "dependency (?:resolution )?failed", "autowire"),
    ),
    (
        "circular-dependency", "configuration", "critical", "Circular dependency between modules", ("java", "spring", "python", "go", "node"),
        ("circular (?:dependency|reference|initialization)", "bean is not eligible for getting processed by all bean post-processors", "cyclic (?:dependency|reference)", "requires? bean .* which is currently in creation", "circular import", "partially initialized"),
    ),
    (
        "invalid-binding", "configuration", "warning", "Configuration property cannot be bound", ("any",),
        ("cannot bind (?:property|value)", "failed to bind (?:property|properties)", "unbound configuration", "placeholder .* (?:not|has no) value", "conversion failed.*(?:property|configuration)", "type mismatch.*(?:property|config)", "no setter found for property"),
    ),
    (
        "missing-secret", "configuration", "critical", "Secret or API key missing", ("any",),
        ("(?:secret|token|api[_-]?key|credential) .*(?:not (?:set|found|configured)|is (?:missing|required|empty))", "could not find (?:credentials|api key|secret)", "credentials not found", "unauthenticated(?: request)?", "401 unauthorized.*config"),
    ),
    (
        "linkage-error", "dependencies", "critical", "Class/ABI incompatibility", ("java", "jvm", "dotnet", "native"),
        ("unsupportedclassversionerror", "noclassdeffounderror", "nosuchmethoderror", "nosuchfielderror", "nocuchymethoderror", "absent method", "incompatible class change", "classnotfound(?:exception)?", "dlopen failed"),
    ),
    (
        "missing-transitive", "dependencies", "critical", "Missing transitive dependency", ("java", "node", "python", "dotnet", "go"),
        ("no module named", "cannot find module", "module not found", "modulenotfounderror", "could not find artifact", "package .* is not (?:installed|on the)", "requires? .* but it is (?:not|missing)", "unresolved dependency"),
    ),
    (
        "service-discovery", "dependencies", "warning", "Service discovery / registry failure", ("any",),
        ("service (?:not )?found in (?:registry|eureka|consul)", "no instances available", "no healthy instances", "registry (?:unavailable|down)", "discovery client", "dns[- ]?srv"),
    ),
    (
        "api-deprecation", "dependencies", "info", "Deprecated API in use", ("any",),
        ("deprecat(?:ed|ion)", "will be removed in", "no longer supported", "end of life", "eol", "sunset date", "legacy (?:endpoint|version|api)"),
    ),
)


def rules_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """id, category, label, severity, title, languages, reasons, fixes, patterns: one row for each rule."""
    told = lambda r, k: [ADVICE[r[0]][k]] if r[0] in ADVICE else []
    rows = [(r[0], r[1], CATEGORIES.get(r[1], r[1]), r[2], r[3], list(r[4]), told(r, 0), told(r, 1), list(r[5])) for r in rules]
    kinds = "id string, category string, label string, severity string, title string, languages array<string>, reasons array<string>, fixes array<string>, patterns array<string>"
    return spark.createDataFrame(rows, kinds)


def category_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.count("*").alias("count"))


def search(rules: DataFrame, needle: str = "", category: str | None = None, severity: str | None = None) -> DataFrame:
    """Rules of a category and a severity that hold the text in their title, reasons, fixes or languages, whatever its case."""
    low = F.lit(needle.strip().lower())
    texts = F.concat(F.array("title"), "reasons", "fixes", "languages")
    out = rules.where(F.exists(texts, lambda t: F.contains(F.lower(t), low)))
    out = out if category is None else out.where(F.col("category") == category)
    return out if severity is None else out.where(F.col("severity") == severity)


def alternation(rule: tuple) -> str:
    """A rule's patterns as one."""
    return "|".join(rule[5])


def _hits(text: Sql, rules: tuple) -> Column:
    """Places in ``rules`` whose pattern the text, in lower case, meets. Patterns are literal: each is compiled once."""
    met = lambda r: functools.reduce(lambda a, b: a | b, (meets(text, text, p) for p in r[5]))
    return X.array_compact(X.array(*(X.when(met(r), k) for k, r in enumerate(rules)))).column


def issue_rules(issues: DataFrame, rules: tuple = RULES, with_file_name: bool = True) -> DataFrame:
    """issues x rules: the columns of ``issues`` and ``rule``, a place in ``rules``."""
    name = F.element_at(F.split("file_id", "/"), -1) if with_file_name else F.lit("")
    text = lambda *parts: F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))
    shown = text(F.col("pattern"), F.col("title"), F.col("exception_type"), name)
    samples = F.lower(F.array_join(F.transform("samples", lambda s: s["raw"]), " "))
    either = F.array_union(_hits(X.col("d_shown"), rules), _hits(X.col("d_samples"), rules))
    return issues.withColumn("d_shown", shown).withColumn("d_samples", samples).withColumn("rule", F.explode(either)).drop("d_shown", "d_samples")


def known_problems(issues: DataFrame, exceptions: DataFrame, rules: tuple = RULES, with_file_name: bool = True) -> DataFrame:
    """file_id, id, title, category, severity, occurrences, issue_ids, example, place: met rules, the most severe first.

    ``issues`` has file_id, signature, pattern, title, exception_type, count, samples and place; ``exceptions`` has file_id,
    type, count and first_line.
    """
    from timberline.operators.aggregate import top

    hit = issue_rules(issues, rules, with_file_name)
    met = hit.groupBy("file_id", "rule").agg(
        F.sum("count").alias("occurrences"), F.transform(F.array_sort(F.collect_list(F.struct("place", "signature"))), lambda s: s["signature"]).alias("issue_ids"),
        F.min_by(F.get(F.col("samples"), F.lit(0))["raw"], F.when(F.size("samples") > 0, F.col("place"))).alias("example"),
    )
    kinds = exceptions.withColumn("rule", F.explode(_hits(X.lower(X.col("type")), rules))).join(met.select("file_id", "rule"), ["file_id", "rule"], "left_anti")
    # The first type in the file's order that meets the rule.
    by_type = kinds.groupBy("file_id", "rule").agg(F.min_by(F.struct("count", "type"), "first_line").alias("t"))
    by_type = by_type.select("file_id", "rule", F.col("t.count").alias("occurrences"), F.array().cast("array<string>").alias("issue_ids"), F.col("t.type").alias("example"))
    facts = F.array(*(F.struct(F.lit(r[0]).alias("id"), F.lit(r[3]).alias("title"), F.lit(r[1]).alias("category"), F.lit(r[2]).alias("severity")) for r in rules))
    # Of equal ranks, problems met by issues come before those met by a type only.
    out = met.withColumn("phase", F.lit(0)).unionByName(by_type.withColumn("phase", F.lit(1))).withColumn("r", F.get(facts, F.col("rule")))
    weight = F.when(F.col("r.severity") == "critical", 3).when(F.col("r.severity") == "warning", 2).otherwise(1)
    out = out.select("file_id", "r.*", "occurrences", "issue_ids", "example", weight.alias("w"), "phase", "rule")
    return top(out, [F.desc("w"), F.desc("occurrences"), F.asc("phase"), F.asc("rule")], len(rules)).drop("w", "phase", "rule")


def issue_labels(problems: DataFrame) -> DataFrame:
    """file_id, signature, label: ``category: title`` of the last met rule that names the issue."""
    each = problems.select("file_id", F.explode("issue_ids").alias("signature"), F.concat_ws(": ", "category", "title").alias("label"), "place")
    return each.groupBy("file_id", "signature").agg(F.max_by("label", "place").alias("label"))


CSV_COLUMNS = ("id", "category", "severity", "title", "languages", "reasons", "fixes", "patterns")


def csv_lines(rules: DataFrame) -> DataFrame:
    """place, line: a header (place 0) and one CSV line for each rule, by id."""
    many = lambda c: X.array_join(X.col(c), " | ")
    cells = [X.col("id"), X.col("label"), X.col("severity"), X.col("title"), many("languages"), many("reasons"), many("fixes"), many("patterns")]
    rows = rules.select(F.row_number().over(W.orderBy("id")).alias("place"), X.concat_ws(",", *(csv_cell(c) for c in cells)).alias("line").column)  # some hundred rows
    head = rules.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    return head.union(rows)


def to_json(rules: DataFrame) -> str:
    """The rules as a JSON text; a table of at most some hundred rows."""
    rows = [r.asDict() for r in rules.collect()]
    keys = {"id": "id", "title": "title", "category": "category", "categoryLabel": "label", "severity": "severity", "languages": "languages", "reasons": "reasons", "fixes": "fixes", "patterns": "patterns"}
    return json.dumps([{k: r[c] for k, c in keys.items()} for r in rows], indent=2, ensure_ascii=False)
