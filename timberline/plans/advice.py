"""Our own words on each known problem of the directory: id -> (why it tends to happen, what to do about it)."""

from __future__ import annotations

ADVICE = {
    "null-reference": ("A value that the code takes for granted was never set, or a lookup found nothing.", "Open the line of the top frame, see which of its values can be absent, and decide there what absence means."),
    "index-out-of-range": ("A position was computed for a list of another length, often at its very end or for an empty one.", "Log position and length together, then test with no element, one element and the last one."),
    "panic-abort": ("The runtime gave up on a state that it can't go on from.", "Keep the core file or the full dump, and read the first frame that is the program's own."),
    "unhandled-exception": ("An error left every handler, often in a callback or a task that nobody waits for.", "Wait for every task, and add one handler at the edge that logs and answers."),
    "out-of-memory": ("More is held at once than the limit allows: a whole file, a growing map, a queue without a bound.", "Take a heap dump near the limit and see what holds most; then read in parts or bound the container."),
    "gc-pressure": ("Objects are made faster than they can be collected, or the heap is nearly full of live ones.", "Look at the allocation rate and at the live set after a full collection before changing heap sizes."),
    "resource-limits": ("Handles, threads or quota are taken and not given back, or the limit is lower than the load needs.", "Count open handles by kind over time, and close them on every way out of the code."),
    "deadlock": ("Two parties each hold what the other waits for.", "Take all locks in one fixed order, and dump the threads while it lasts to see both sides."),
    "race-condition": ("Two parties read and write the same thing without agreeing who goes first.", "Give the data one owner, or make the step atomic; then repeat the test under load."),
    "timeout": ("The callee was slower than the caller was ready to wait, or never got the call.", "Compare both sides' times for one call, and set limits that grow from the inner call outwards."),
    "connection-refused": ("Nobody listens at that address, or the other side closed the connection while it was in use.", "Check from the same host that the port answers, and that idle times agree on both sides."),
    "dns-tls": ("A name doesn't resolve from here, or a certificate isn't trusted, has expired or is for another name.", "Resolve the name on the failing host, and print the certificate's dates, names and issuer."),
    "db-constraint": ("A row breaks a rule of the schema: it exists already, or what it points to doesn't.", "Find the statement and its values, and check the rule in the code before writing."),
    "db-timeout": ("A statement waits for a lock or reads far more rows than it returns.", "Look at its plan with real values, and at what held locks at that time."),
    "db-unavailable": ("The database is down, changes over, or takes no more connections.", "Check its own log and the count of connections, and retry with growing pauses."),
    "http-5xx": ("The server failed while it answered, or one behind it did.", "Take one failing route, follow its request id through the services, and fix the first that fails."),
    "http-4xx": ("Callers ask for what isn't there, isn't allowed or isn't well formed.", "Group the requests by route and caller; one old client or one broken link often makes most of them."),
    "rate-limit": ("More calls are made in a time than the other side grants.", "Honour its wait header, spread the calls, and cache what is asked again and again."),
    "auth-failure": ("Credentials are wrong, expired or lack a right; or somebody is guessing.", "Separate one account with many failures from many accounts with one, and check the clock for expiry."),
    "injection": ("Input is used as part of a command, a query or an address.", "Pass values as parameters, check them against what is allowed, and look for what got through."),
    "corruption": ("Bytes changed or went missing between writing and reading.", "Compare checksums on each hop, and keep the damaged copy before anything repairs it."),
    "deserialization": ("A payload isn't in the form that the reader was built for.", "Store one bad payload, compare it with the expected form, and see which writer sent it."),
    "config-missing": ("A setting is absent or can't be read in this environment.", "Check all settings at start and name each that is missing, before any work begins."),
    "env-drift": ("Two environments that should be equal have other versions or settings.", "Print versions and settings at start in both, and compare the prints."),
    "slow-operation": ("One step takes far longer than the others of its kind.", "Time its parts, and look for work that is repeated for each element."),
    "cpu-hot": ("A loop uses all of a core, be it real work, spinning or collection.", "Sample the stacks for some seconds and look at what is on top most often."),
    "dependency-conflict": ("Two parts want other versions of the same library.", "Print the tree of dependencies and pin the one version that both can use."),
    "schema-mismatch": ("Writer and reader disagree on the fields of a message.", "Compare both schemas, and allow additions on the reader's side before the writer sends them."),
    "stack-overflow": ("A function calls itself, perhaps through others, without an end.", "Look for the frames that repeat, and for the input that never reaches the stop."),
    "class-cast": ("A value has another type than the code claims.", "Find where the value comes from; a mixed collection or a second class loader is common."),
    "illegal-argument": ("A function was called with a value outside of what it accepts.", "Check the value where it enters the system, and say in the error which value it was."),
    "arithmetic-error": ("A divisor was zero or a number left its range.", "Handle the empty case before dividing, and use a wider type where sums grow."),
    "resource-closed": ("Something is used after it was closed, often by another thread or a late callback.", "Let the one that opens it also close it, and wait for its users first."),
    "memory-leak": ("Things stay reachable after their use: listeners, caches without an end, thread locals.", "Compare two heap dumps some hours apart and look at what only grows."),
    "metaspace": ("Classes are loaded again and again, by redeployment, scripts or proxies.", "Count loaded classes over time, and look for class loaders that are never freed."),
    "buffer-overflow": ("Native code wrote or read beyond its buffer.", "Run the case under a sanitizer, and check lengths before each copy."),
    "thread-interrupted": ("Work was told to stop while it waited.", "Pass the interruption on, clean up, and see whether a shutdown or a time limit caused it."),
    "atomicity-violation": ("A value was read, changed and written while another writer did the same.", "Do it in one statement or with a version check, and retry the loser."),
    "semaphore-permit": ("All permits or slots were taken when another was needed.", "See how long holders keep them, and whether they return them after an error."),
    "proxy-failure": ("A proxy between caller and service couldn't connect, or got no usable answer.", "Ask the service without the proxy; then compare the proxy's limits with the answer's size and time."),
    "url-parse-error": ("An address was put together from parts that weren't escaped or were empty.", "Build addresses with a library, and log the parts when one is refused."),
    "http2-protocol": ("Client and server disagree on a stream's state, or one side reset it.", "Update both ends, compare their limits of streams and header sizes, and try the older protocol."),
    "replication-lag": ("A replica is behind, so that what was just written can't be read there.", "Read own writes from the primary, and look for long transactions on the replica."),
    "connection-dropped": ("A connection went away in the middle of a statement: restart, idle limit or network.", "Test connections before use, and make the statement safe to run again."),
    "transaction-rollback": ("A transaction met a conflict or an earlier error and was undone.", "Find the first error in it, keep transactions short, and retry those that lost."),
    "db-migration": ("The schema isn't at the version that the program expects.", "Compare the list of applied migrations, and deploy changes in steps that both versions can run on."),
    "query-plan-regression": ("A statement reads a whole table where it used an index, after growth or new statistics.", "Compare its plan with the old one, refresh statistics, and add the index that it lacks."),
    "payload-too-large": ("A body is larger than a server or proxy on the way accepts.", "Send it in parts or compressed, or raise the smallest of the limits on the way."),
    "validation-error": ("Input lacks a field or has a value outside of the rules.", "Answer with field and rule, and count them by field to see whether a form is misleading."),
    "unsupported-media": ("The stated content type isn't one that the receiver reads.", "Set the header to what is really sent, and list what is accepted in the refusal."),
    "gateway-timeout": ("The service behind a gateway answered too late for it.", "Make long work asynchronous, and set the gateway's limit above the service's own."),
    "not-implemented": ("A route or an operation is called that this version doesn't have.", "Check that caller and server are of versions that fit, and hide what isn't there."),
    "cors": ("A browser asked from an origin, or with headers, that the server doesn't list.", "Add exactly that origin and those headers to the answer of the preflight request."),
    "path-traversal": ("Somebody tried to leave a folder by dots in a path.", "Resolve the path first and refuse what isn't below the folder; then look at what else that caller asked."),
    "ssrf": ("A caller made the server fetch an address of the caller's choice.", "Allow only known hosts, refuse internal ranges after resolving, and don't follow redirects blindly."),
    "weak-crypto": ("A cipher, hash or key is in use that is no longer safe.", "List where it is used, move to a current one, and renew what it protected."),
    "insecure-transport": ("Secrets went over a connection that isn't encrypted.", "Force encrypted connections, and treat what was sent as known to others."),
    "log-injection": ("Line breaks or control characters from input reached the log.", "Escape input when logging, or log it as a field of a structured line."),
    "data-loss": ("Records that were accepted can't be found any more.", "Stop what deletes, count both ends by time, and restore from the last point where they agree."),
    "numeric-precision": ("Amounts were rounded or summed in a type that can't hold them exactly.", "Use decimals with a stated scale, and round once, at the end."),
    "state-machine": ("Something was told to change in a way that its state doesn't allow.", "Log state and event together, and look for events that come twice or out of order."),
    "queue-unavailable": ("The broker can't be reached or has no leader.", "Check the broker's health and the addresses it announces, and keep messages until it is back."),
    "queue-full": ("Producers are faster than consumers, and there is no more room.", "Slow the producers down, add consumers, and decide what may be dropped."),
    "consumer-lag": ("Consumers fall behind, by slow work, too few of them, or one hot partition.", "Compare lag by partition; spread the hot key or add consumers up to the partitions."),
    "poison-message": ("One message fails each time it is tried and holds up the rest.", "Set it aside after some tries, with its error, and go on."),
    "offset-reset": ("A consumer lost its place and began elsewhere.", "See whether its place expired or its group changed, and make the work safe to do twice."),
    "cache-stampede": ("A popular entry expired and everybody computed it anew at once.", "Let one compute it while the others wait or get the old value, and vary expiry times."),
    "cache-unavailable": ("The cache is away, or throws out what is still needed.", "Go on without it at a bounded rate, and compare its memory with what is used often."),
    "stale-cache": ("A value changed but its cached copy stayed.", "Delete or version the copy when the value is written, and shorten its life."),
    "cache-penetration": ("Keys that don't exist are asked for, and each miss reaches the database.", "Cache the answer that there is nothing for a short time, and check keys before asking."),
    "third-party-api": ("A service outside failed or changed its answers.", "Check its status page, keep the answer, and have a plan for when it is away."),
    "email-delivery": ("A mail server refused or delayed a message.", "Read the code in its answer: try again later for a delay, mend the address or the sender's standing for a refusal."),
    "object-storage": ("A bucket or an object couldn't be read or written.", "Check name, region and rights with the same identity, and retry what is throttled."),
    "webhook-delivery": ("The receiver of an event didn't answer well in time.", "Retry with growing pauses, sign the events, and let the receiver answer before it works."),
    "payment-gateway": ("A payment was declined, or its outcome is unknown.", "Ask the provider for the outcome by a key of your own before trying again."),
    "oom-killed": ("A container used more memory than its limit and was killed.", "Compare its peak with the limit, count what lies outside of the heap, and set both together."),
    "crash-loop": ("A container ends soon after its start, again and again.", "Read the log of the run before, and start it by hand with the same settings."),
    "image-pull": ("An image or a package couldn't be fetched.", "Check its name and tag, the registry's credentials, and whether a limit of pulls was met."),
    "probe-failure": ("A health check got no good answer in time.", "Call the check from inside, give a slow start more time, and keep the check itself cheap."),
    "resource-throttling": ("A container is held back because it used its share of processor time.", "Look at the throttled periods, and raise the limit or lower the number of threads."),
    "insufficient-balance": ("An account or a quota doesn't cover what was asked.", "Tell the caller what is missing, and check before the work starts, not after."),
    "inventory": ("More was promised than there is in stock.", "Reserve in one atomic step when ordering, and free reservations that lapse."),
    "duplicate-submission": ("The same request came twice, by a double click or a retry.", "Give each request a key and answer the second one with the result of the first."),
    "mandatory-field": ("A field that has to be there was left out.", "Mark it in the form and in the schema, and refuse with its name."),
    "unicode-error": ("Bytes were read in another encoding than they were written in.", "Name the encoding at each border, and look at the first byte that fails."),
    "timezone-missing": ("A time has no zone, or one that doesn't exist here or at that hour.", "Store instants in UTC, keep the zone beside them, and update the zone data."),
    "locale-missing": ("A text or a format for a language isn't there.", "Add the entry, fall back to a known language, and test with each one that is offered."),
    "job-missed": ("A job didn't start when it was due: the scheduler was down, busy or in another zone.", "Watch for the absence of a success, not only for errors, and state the zone."),
    "job-overlap": ("A run started before the one before it had ended.", "Take a lock for the job, or skip the start while one runs, and look at why it takes longer."),
    "job-stuck": ("A job runs but doesn't get on.", "Give it a limit of time and a sign of progress, and dump its threads when it misses it."),
    "log-flooding": ("One line is written so often that it hides others and fills the disk.", "Limit it by rate, count instead of repeating, and fix what causes it."),
    "error-swallowed": ("An error is caught and nothing is done about it.", "Log it with its cause or pass it on, and search for empty handlers near that place."),
    "sampling-loss": ("Lines are left out on purpose or cut, so that the log isn't whole.", "Never sample errors, and write down the rate next to what is kept."),
    "log-truncation": ("An entry ends before its end: a limit of length or a crash while writing.", "Raise the limit or split long entries, and flush before the process ends."),
    "injection-failure": ("The container found no part, or more than one, for a place that needs one.", "Check that the part is scanned and named as asked, and that its own needs are met."),
    "circular-dependency": ("Two modules need each other before either is ready.", "Move what both need into a third, or hand it over when it is first used."),
    "invalid-binding": ("A property has a value that doesn't fit the type it is read into.", "Compare value and type, units too, and check all of them at start."),
    "missing-secret": ("A key or a password isn't where the program looks for it.", "Check the mount or the variable in the running environment, and name the secret, never its value."),
    "linkage-error": ("Code was built against another version of a class than it runs with.", "Look for the class in more than one archive, and build all parts against one version."),
    "missing-transitive": ("Something that a dependency needs isn't packed with the program.", "Compare the packed list with the tree of dependencies, and add what is marked as provided."),
    "service-discovery": ("A service isn't registered, or the registry can't be asked.", "Look at its registration and health there, and keep the last known addresses."),
    "api-deprecation": ("An interface is in use that is going away.", "Note the date, find all callers, and move them one by one to what replaces it."),
}
