"""Small source files used by several tests."""

FILES = {
    "src/base.ts": """// Base of all processors.
export abstract class Base {
  abstract run(): void;
}

export interface Formatter {
  format(value: string): string;
}
""",
    "src/derived.ts": """import { Base, Formatter } from './base';
import { formatValue } from './utils';

/** Runs the work. */
export class Derived extends Base implements Formatter {
  run(): void {
    this.format("x");
  }

  format(value: string): string {
    return formatValue(value);
  }
}
""",
    "src/utils.ts": """export function formatValue(value: string): string {
  return value.trim();
}

export function processValue(value: string): string {
  return formatValue(value);
}

function unusedHelper() {
  return 42;
}
""",
    "src/main.ts": """import { processValue } from './utils';
import { Derived } from './derived';

export function main() {
  const d = new Derived();
  d.run();
  processValue("a");
  register(main);
}
""",
    "app/service.py": '''import os
from app.models import User


# Stores users.
class Service(Base):
    LIMIT = 3

    def save(self, user):
        if user:
            helper(user)
        return user

    def load(self):
        return [
            self.save(None),
        ]


@app.route("/users/<id>")
def get_user(id):
    return Service().load()


def helper(user):
    return user
''',
    "pkg/server.go": """package pkg

import "fmt"

type Store interface {
	Get(key string) string
}

type Server struct {
	name string
}

func (s *Server) Get(key string) string {
	return fmt.Sprint(key)
}

func NewServer() *Server {
	return &Server{}
}

func routes(r *Engine) {
	r.GET("/ping", ping)
	r.Use(auth)
}
""",
    "java/User.java": """package java;

public class User extends Person implements Named, Other {
    private String name;

    public String getName() {
        return name;
    }
}
""",
}


def frame(spark, files=FILES):
    rows = [(p, t, len(t), 0) for p, t in files.items()]
    from strandgraph.sources.files import with_content

    return with_content(spark.createDataFrame(rows, "path string, content string, size long, modified_at long"))
