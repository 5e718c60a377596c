"""The rows that the operators must give on the fixtures, stated by hand."""

from __future__ import annotations

#: Query to its columns and rows.
ROWS: dict[str, tuple[str, list[tuple]]] = {
    "extracted_nodes": ("id VARCHAR, kind VARCHAR, line INTEGER", [
        ('app/main.py:Door', 'Class', 4),
        ('app/main.py:Door::__init__', 'Method', 5),
        ('app/main.py:Door::open', 'Method', 8),
        ('app/main.py:run', 'Function', 11),
        ('c/util.c:add', 'Function', 5),
        ('c/util.c:twice', 'Function', 3),
        ('crates/core/Cargo.toml:core-lib', 'Crate', None),
        ('crates/core/src/lib.rs:Point', 'Class', 11),
        ('crates/core/src/lib.rs:Point::len', 'Method', 13),
        ('crates/core/src/lib.rs:checks', 'Test', 16),
        ('crates/core/src/lib.rs:helper', 'Function', 10),
        ('crates/core/src/lib.rs:open', 'Function', 4),
        ('datastore:words.sqlite', 'DataStore', None),
        ('doc:paper.pdf', 'Document', None),
        ('file:.claude/skills/notes/SKILL.md', 'File', None),
        ('file:app/main.py', 'File', None),
        ('file:c/util.c', 'File', None),
        ('file:crates/core/Cargo.toml', 'File', None),
        ('file:crates/core/src/lib.rs', 'File', None),
        ('file:jv/a/Box.java', 'File', None),
        ('file:lib/paper.pdf', 'File', None),
        ('file:lib/words.sqlite', 'File', None),
        ('file:srv/main.go', 'File', None),
        ('file:web/view.ts', 'File', None),
        ('jv/a/Box.java:Box', 'Class', 5),
        ('jv/a/Box.java:Box::first', 'Method', 6),
        ('jv/a/Box.java:Box::hide', 'Method', 7),
        ('skill:notes', 'Skill', None),
        ('srv/main.go:Serve', 'Function', 8),
        ('srv/main.go:step', 'Function', 14),
        ('web/view.ts:View', 'Class', 2),
        ('web/view.ts:View::draw', 'Method', 3),
        ('web/view.ts:show', 'Function', 5),
    ]),
    "extracted_facts": ("node_id VARCHAR, tag VARCHAR, value VARCHAR", [
        ('app/main.py:Door', 'pub', ''),
        ('app/main.py:Door::__init__', 'c', '.open'),
        ('app/main.py:Door::open', 'c', 'read'),
        ('app/main.py:Door::open', 'pub', ''),
        ('app/main.py:run', 'c', 'new:Door'),
        ('app/main.py:run', 'c', 'tools.start'),
        ('app/main.py:run', 'pub', ''),
        ('c/util.c:twice', 'c', 'add'),
        ('c/util.c:twice', 'pub', ''),
        ('crates/core/src/lib.rs:Point::len', 'c', '.size'),
        ('crates/core/src/lib.rs:Point::len', 'pub', ''),
        ('crates/core/src/lib.rs:helper', 'a', 'state.db'),
        ('crates/core/src/lib.rs:helper', 'c', 'std::fs::write'),
        ('crates/core/src/lib.rs:helper', 'io', 'w'),
        ('crates/core/src/lib.rs:open', 'c', '.load'),
        ('crates/core/src/lib.rs:open', 'c', 'Store::new'),
        ('crates/core/src/lib.rs:open', 'c', 'db::check'),
        ('crates/core/src/lib.rs:open', 'c', 'helper'),
        ('crates/core/src/lib.rs:open', 'pub', ''),
        ('file:app/main.py', 'b', 'app|*|app.tools'),
        ('file:app/main.py', 'b', 'read|load|.store'),
        ('file:app/main.py', 'loc', '10'),
        ('file:c/util.c', 'b', '*|*|util.h'),
        ('file:c/util.c', 'loc', '3'),
        ('file:crates/core/src/lib.rs', 'loc', '14'),
        ('file:jv/a/Box.java', 'b', 'Item|Item|a.b.Item'),
        ('file:jv/a/Box.java', 'loc', '6'),
        ('file:jv/a/Box.java', 'ty', 'Box'),
        ('file:jv/a/Box.java', 'ty', 'Item'),
        ('file:srv/main.go', 'b', 'fmt|*|fmt'),
        ('file:srv/main.go', 'b', 'store|*|host.io/x/store'),
        ('file:srv/main.go', 'loc', '9'),
        ('file:srv/main.go', 'ty', 'Open'),
        ('file:srv/main.go', 'ty', 'Println'),
        ('file:srv/main.go', 'ty', 'Serve'),
        ('file:web/view.ts', 'b', 'p|paint|./util'),
        ('file:web/view.ts', 'loc', '5'),
        ('jv/a/Box.java:Box', 'pub', ''),
        ('jv/a/Box.java:Box::first', 'c', 'new:Item'),
        ('jv/a/Box.java:Box::first', 'pub', ''),
        ('jv/a/Box.java:Box::hide', 'c', 'first'),
        ('srv/main.go:Serve', 'c', 'step'),
        ('srv/main.go:Serve', 'c', 'store.Open'),
        ('srv/main.go:Serve', 'pub', ''),
        ('web/view.ts:View', 'pub', ''),
        ('web/view.ts:View::draw', 'c', 'p'),
        ('web/view.ts:View::draw', 'pub', ''),
        ('web/view.ts:show', 'c', 'new:View'),
        ('web/view.ts:show', 'c', 'v.draw'),
        ('web/view.ts:show', 'pub', ''),
    ]),
    "extracted_imports": ("file_id VARCHAR, pos INTEGER, spec VARCHAR", [
        ('file:app/main.py', 0, 'py:.store'),
        ('file:app/main.py', 1, 'py:app.tools'),
        ('file:crates/core/Cargo.toml', 0, 'cargo:package|core-lib|0||1|'),
        ('file:crates/core/Cargo.toml', 1, 'cargo:dep|util|0|1|0|../util'),
        ('file:crates/core/Cargo.toml', 2, 'cargo:dep|serde|0|0|0|'),
        ('file:crates/core/Cargo.toml', 3, 'cargo:dep|fake|0|0|1|../fake'),
        ('file:crates/core/src/lib.rs', 0, 'rs:crate::db::Store'),
        ('file:crates/core/src/lib.rs', 1, 'rs:util::text'),
        ('file:crates/core/src/lib.rs', 2, 'rs:util::fold'),
        ('file:crates/core/src/lib.rs', 3, 'rs:db::check'),
        ('file:crates/core/src/lib.rs', 4, 'rs:std::fs::write'),
        ('file:web/view.ts', 0, 'js:./util'),
    ]),
    "ecosystem": ("source VARCHAR, target VARCHAR, relation VARCHAR, confidence DOUBLE", [
        ('skill:notes', 'doc:govde.txt', 'Produces', 1.0),
        ('skill:notes', 'doc:paper.pdf', 'Writes', 0.9),
    ]),
    "test_paths": ("path VARCHAR, rust BOOLEAN, other BOOLEAN, package BOOLEAN", [
        ('ATest.java', False, True, False),
        ('a/fixtures/c.rs', False, False, True),
        ('a/spec/x.js', False, True, False),
        ('a/test/x.py', False, True, False),
        ('a/tests/x.rs', True, True, True),
        ('benches/b.rs', True, False, True),
        ('pkg/x_test.go', False, True, False),
        ('src/contest.rs', False, False, False),
        ('src/tests.rs', True, False, False),
        ('x.test.ts', False, True, False),
    ]),
    "script_imports": ("file VARCHAR, spec VARCHAR, other_file VARCHAR", [
        ('/abs/x.js', './y/z', '/abs/y/z.ts'),
        ('web/a.ts', './b', 'web/b.tsx'),
        ('web/a.ts', './lib', 'web/lib/index.js'),
        ('web/lib/index.js', '../c.mjs', 'web/c.mjs'),
    ]),
    "python_imports": ("file VARCHAR, spec VARCHAR, other_file VARCHAR", [
        ('app/main.py', '.store', 'app/store.py'),
        ('app/main.py', '.sub', 'app/sub/__init__.py'),
        ('app/main.py', 'lib.only', 'lib/only.py'),
        ('app/sub/deep.py', '.', 'app/sub/__init__.py'),
        ('app/sub/deep.py', '..store', 'app/store.py'),
    ]),
    "python_bindings": ("file VARCHAR, spec VARCHAR, other_file VARCHAR", [
        ('m.py', 'a.b.c.d.e', 'r/a/b/c/d/e.py'),
        ('m.py', 'both', 'x/both.py'),
        ('m.py', 'both', 'y/both.py'),
        ('m.py', 'lib.only', 'lib/only.py'),
        ('m.py', 'only', 'lib/only.py'),
    ]),
    "go_imports": ("file VARCHAR, spec VARCHAR, other_file VARCHAR", [
        ('m/cmd/e.go', 'host.io/x/store', 'm/x/store/a.go'),
        ('m/cmd/e.go', 'host.io/x/store', 'm/x/store/b.go'),
        ('m/cmd/e.go', 'm/solo', 'm/solo/d.go'),
        ('m/cmd/e.go', 'solo', 'm/solo/d.go'),
    ]),
    "java_imports": ("file VARCHAR, spec VARCHAR, other_file VARCHAR", [
        ('jv/M.java', 'a.b.Item', 'jv/a/b/Item.java'),
        ('jv/M.java', 'a.b.Item', 'old/a/b/Item.java'),
        ('jv/M.java', 'a.c', 'jv/a/c/One.java'),
        ('jv/M.java', 'a.c', 'jv/a/c/Two.java'),
    ]),
    "c_imports": ("file VARCHAR, spec VARCHAR, other_file VARCHAR", [
        ('c/main.c', 'net/sock.hpp', 'inc/net/sock.cc'),
        ('c/main.c', 'net/sock.hpp', 'inc/net/sock.cpp'),
        ('c/main.c', 'net/sock.hpp', 'inc/net/sock.hpp'),
        ('c/main.c', 'util.h', 'c/util.c'),
        ('c/main.c', 'util.h', 'c/util.h'),
    ]),
    "rust_imports": ("file VARCHAR, other_file VARCHAR", [
        ('w/core/src/db/mod.rs', 'w/core/src/db/rows.rs'),
        ('w/core/src/db/rows.rs', 'w/core/src/db/deep/leaf.rs'),
        ('w/core/src/db/rows.rs', 'w/core/src/lib.rs'),
        ('w/core/src/db/rows.rs', 'w/util/src/text.rs'),
        ('w/core/src/lib.rs', 'w/core/src/db/rows.rs'),
        ('w/core/src/lib.rs', 'w/util/src/text.rs'),
        ('w/util/src/text.rs', 'w/core/src/db/mod.rs'),
    ]),
    "other_language_calls": ("source VARCHAR, target VARCHAR, confidence DOUBLE", [
        ('a:draw', 'a:own', 0.95),
        ('a:draw', 'u:View::constructor', 0.85),
        ('a:draw', 'u:View::refresh', 0.6),
        ('a:draw', 'u:paint', 0.9),
        ('g:Serve', 'h:step', 0.75),
    ]),
    "artifact_flow": ("source VARCHAR, target VARCHAR, relation VARCHAR, confidence DOUBLE", [
        ('reader', 'artifact:state.db', 'Reads', 0.9),
        ('writer', 'artifact:out.csv', 'Writes', 0.9),
    ]),
    "path_rules": ("base VARCHAR, spec VARCHAR, joined VARCHAR, repo VARCHAR, module VARCHAR", [
        ('', 'y/z', 'y/z', 'y', 'z'),
        ('/a/b', '../c/./d', '/a/c/d', 'c', 'd'),
        ('C:/a', 'b', 'C:/a/b', 'b', 'b'),
        ('a/b', '../../../x', 'x', 'x', 'x'),
        ('w/core', '../../far/lib', 'far/lib', 'far', 'lib'),
        ('w/core', '../core', 'w/core', 'core', 'core'),
        ('w/core/x', '../..', 'w', 'w', 'w'),
    ]),
    "shared_prefix": ("name VARCHAR, n INTEGER, root VARCHAR", [
        ('empty', 0, 'root'),
        ('none', 0, 'root'),
        ('one', 2, 'w'),
        ('two', 1, 'r'),
    ]),
    "layered": ("name VARCHAR, node INTEGER, layer INTEGER, by_place INTEGER, place INTEGER", [
        ('chain', 0, 0, 0, 0),
        ('chain', 1, 1, 1, 0),
        ('chain', 2, 2, 2, 0),
        ('cross', 0, 0, 0, 1),
        ('cross', 1, 0, 0, 0),
        ('cross', 2, 1, 1, 0),
        ('cross', 3, 1, 1, 1),
        ('cross', 4, 1, 1, 2),
        ('cycle', 0, 0, 0, 0),
        ('cycle', 1, 1, 1, 0),
        ('late', 0, 1, 1, 0),
        ('late', 1, 2, 2, 0),
        ('late', 2, 0, 0, 0),
        ('late', 3, 0, 0, 1),
        ('skip', 0, 0, 0, 0),
        ('skip', 1, 1, 1, 0),
        ('skip', 2, 2, 2, 0),
    ]),
    "sequence_messages": ("place INTEGER, caller VARCHAR, callee VARCHAR, action VARCHAR, later BOOLEAN", [
        (1, 'x/main.rs:main', 'x/b.rs:b', 'calls b()', False),
        (2, 'x/b.rs:b', 'x/c.rs:c', 'calls c()', True),
        (3, 'x/c.rs:c', 'x/d.rs:d', 'calls d()', False),
    ]),
    "package_tour": ("step INTEGER, title VARCHAR, description VARCHAR, nodes VARCHAR", [
        (1, '1. Entry points', 'Crates the user starts: cli. cli → core (uses ×3).', 'cli'),
        (2, '2. Core', 'What the other crates stand on: core. core → store (uses ×2). Public API: open, close.', 'core'),
        (3, '3. Storage and data', 'Crates that keep persistent data: store.', 'store'),
        (4, '4. Interface', 'The layer the user sees: panel. panel → core (uses ×5).', 'panel'),
        (5, '5. Outside repositories', 'Sibling repositories this workspace depends on: x.', 'ext:far/x'),
    ]),
    "module_tour": ("step INTEGER, title VARCHAR, description VARCHAR, nodes VARCHAR", [
        (1, '1. Entry', 'Modules nobody else uses, where work starts: cli.', 'cli'),
        (2, '2. Middle layer', 'Hub modules that both use and are used: core, panel.', 'core panel'),
        (3, '3. Foundation', 'Leaf modules that use nothing else: x, store.', 'ext:far/x store'),
    ]),
    "board_report": ("path VARCHAR, report VARCHAR", [
        ('b.json', 'goal board: b.json\nschema: goals/1\nmission: ship\ngoals: 4 (1 done · 1 partial · 0 active · 0 pending · 0 deferred · 2 unreadable)\n\n  done       A      first\n  partial    B      second\n  unreadable ?3     third\n  unreadable ?4     <not an object>\n\nunreadable, never green: 2\n  ?3     status word: ???\n  ?4     status word: <none>'),
    ]),
    "board_json": ("path VARCHAR, json VARCHAR", [
        ('b.json', '{"schema_valid":true,"green":false,"counts":{"goals":4,"done":1,"partial":1,"active":0,"pending":0,"deferred":0,"unreadable":2},"list":[{"at":1,"id":"A","name":"first","state":"done","status_word":"done"},{"at":2,"id":"B","name":"second","state":"partial","status_word":"kismi","note":"half"},{"at":3,"id":"?3","name":"third","state":"unreadable","status_word":"???"},{"at":4,"id":"?4","name":"<not an object>","state":"unreadable"}]}'),
    ]),
    "board_line": ("path VARCHAR, line VARCHAR", [
        ('b.json', '4 goals · 1 done · 1 partial · 0 active · 0 pending · 0 deferred · 2 unreadable'),
    ]),
}
