"""Facts from source code: definitions, imports, references, bindings and routes, by language adapters."""
