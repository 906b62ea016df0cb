"""Expected Markdown of the derived files, written out by hand.

These texts were derived from the conversion rules, not from the converters, so
they check whole conversions independently. SQL for DuckDB over the columns of
``files`` joined with its document.
"""

from __future__ import annotations

from leafmill.workload.fixture import FIRST_LINE, ID, _Text

PYTHON = '''# {{fname}}

## SDK Documentation

This file contains documentation for `{{fname}}`.

## Module Description

{{trim(%(first)s)}}

## Imports

```python
import os
from lib{{CAST(doc_id %% 5 AS STRING)}} import x
```

## Classes

### `C{{%(id)s}}`

Inherits from: `Base, mixins.Extra`

Class number {{%(id)s}}.

#### Methods

##### `m(self, n: int = 1) -> str`

Method text.

##### `q(self)`

##### `last(x)`

### `D{{%(id)s}}`

## Functions

### `f{{%(id)s}}(a, b: int  = 2, c: Dict[str, int]  = None, d = "z") -> Optional[str]`

Run number {{%(id)s}}.

    Args:
        a (str): first value
        b: second value
           on two lines
        d (int): replaced
        d: kept

    Returns:
        str: what came out

    Examples:
        intro
            f{{%(id)s}}(1)

            f{{%(id)s}}(2)
        end
            g()

**Parameters:**

| Name | Type | Description |
|------|------|-------------|
| `a` | `str` | first value |
| `b` | `int ` | second value
           on two lines |
| `c` | `Dict[str, int] ` |  |
| `d` | `None` | kept |

**Returns:**

Type: `str`

what came out

**Examples:**

```python
intro
f{{%(id)s}}(1)

f{{%(id)s}}(2)
end
g()
```

**Definition:**

```python
@trace
@cache.keep(size=1)
def f{{%(id)s}}(a, b: int = 2, *args, c: Dict[str, int] = None, d="z") -> Optional[str]:
```

### `m(self, n: int  = 1) -> str`

Method text.

**Definition:**

```python
def m(self, n: int = 1) -> str:
```

### `q(self)`

**Definition:**

```python
def q(self):
```

### `last(x)`

**Definition:**

```python
def last(x):
```

## Original Code

```python
{{content}}
```
''' % {"first": FIRST_LINE, "id": ID}

PLAIN_PYTHON = '''# {{fname}}

## Module Description

{{trim(%(first)s)}}

## Functions

### `f{{%(id)s}}(a, b: int = 2, *args, c: Dict[str, int] = None, d="z") -> Optional[str]:
    """Run number {{%(id)s}}.

    Args:
        a (str)`

return g(a)

class C{{%(id)s}}(Base, mixins.Extra):

### `m(self, n: int = 1) -> str:
        """Method text."""
        return str(n)

    def q(self)`

no docstring here

### `last(x)`

{{text}}

## Classes

### `C{{%(id)s}}`

Class number {{%(id)s}}.

### `D{{%(id)s}}`

{{text}}

## Original Code

```python
{{content}}
```
''' % {"first": FIRST_LINE, "id": ID}

NOTEBOOK = '''# {{fname}}

# N{{%(id)s}}

{{text}}

```{{CASE WHEN doc_id %% 2 = 0 THEN 'python' ELSE '' END}}
x = f({{%(id)s}})
y = 1
```

    out {{%(id)s}}
    more

    [image output]

    {{%(id)s}}

[{{%(id)s}}]
''' % {"id": ID}

OPENAPI = '''# API Reference: API {{%(id)s}}

Version: 1.{{CAST(doc_id %% 10 AS STRING)}}

{{text}}

## Data Models

### User

A user

**Properties:**

- `id` (integer): key
- `tags` (array of string): 
- `friends` (array of [User]): 
- `owner` ([Team]): 
- `extra` (object): 

### Team{{%(id)s}}

**Properties:**

- `n` (number): 

## Endpoints

### `GET /items/k{{CAST(doc_id %% 7 AS STRING)}}`

List

Lists {{CAST(n_chars AS STRING)}}

**Parameters:**

- `q` (query, string, required): filter
- `n` (unknown, integer, optional): 
- `None` (path, unknown, optional): 

**Responses:**

- `200`: ok
  Schema: `User`
- `404`: none

### `POST /items/k{{CAST(doc_id %% 7 AS STRING)}}`

Add



**Request Body:**

Content-Type: `application/json`

Schema: `User`

Content-Type: `application/xml`

```json
{
  "type": "object",
  "size": {{%(id)s}}
}
```

**Responses:**

- `201`: 

**Examples:**

Example: one

```json
{
  "id": {{%(id)s}},
  "on": true
}
```

Example: two

```json
"plain"
```

Example: three

### `DELETE /items/{id}`

Del



''' % {"id": ID}

SWAGGER = '''# API Reference: Old {{%(id)s}}

Version: Unknown

## Data Models

### Pet

**Properties:**

- `name` (string): called

### Bare

## Endpoints

### `GET /pets`





**Responses:**

- `200`: ok

''' % {"id": ID}


def markdown_case() -> str:
    """Expected text by route; NULL for what cannot be converted."""
    return f"""CASE
      WHEN route = 'python' THEN {_Text.sql(PYTHON)}
      WHEN route = 'notebook' THEN {_Text.sql(NOTEBOOK)}
      WHEN route = 'api' AND doc_id % 2 = 0 THEN {_Text.sql(OPENAPI)}
      WHEN route = 'api' THEN {_Text.sql(SWAGGER)}
      WHEN route = 'bad_json' THEN NULL
      ELSE content END"""
