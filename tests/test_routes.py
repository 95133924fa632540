"""Mounted routes of source files and ignore rules of many folders."""

from pyspark.sql import functions as F

import sources
from strandgraph.sources import files as S
from strandgraph.sources import ignores
from strandgraph.sources.pipeline import build

PROJECT = {
    "server/app.js": "const express = require('express');\nconst users = require('./routes/users');\nconst app = express();\n"
                     "app.use('/api', users);\napp.use('/v2', auth, require('./routes/items'));\napp.get('/health', ok);\n",
    "server/routes/users.js": "const sub = require('./deep');\nconst router = express.Router();\nrouter.get('/users', list);\nrouter.use('/deep', sub);\n",
    "server/routes/deep.js": "const r = express.Router();\nr.post('/x', make);\n",
    "server/routes/items.js": "const router = express.Router();\nrouter.get('/items', items);\n",
    "fast/main.py": "from fastapi import FastAPI\nfrom fast.routers import users\nfrom fast.admin import router as admin\napp = FastAPI()\n"
                    "app.include_router(users.router, prefix=\"/u\")\napp.include_router(admin)\n\n@app.get(\"/root\")\ndef root():\n    return 1\n",
    "fast/routers/users.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix=\"/own\")\n\n@router.get(\"/me\")\ndef me():\n    return 1\n",
    "fast/admin.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix=\"/admin\")\n\n@router.post(\"/ban\")\ndef ban():\n    return 1\n",
    "dj/urls.py": "from django.urls import include, path\nurlpatterns = [\n    path('shop/', include('dj.shop.urls')),\n    path('home/', home),\n]\n",
    "dj/shop/urls.py": "from django.urls import path\nurlpatterns = [\n    path('cart/', cart),\n]\n",
    "fl/web.py": "import flask\n\n@app.route(\"/save\", methods=['POST', 'PUT'])\ndef save():\n    return 1\n\napi.add_resource(Todo, '/todos')\n",
    "config/routes.rb": "Rails.application.routes.draw do\n  resources :posts, only: [:index, :show]\n  resource :entry, except: [:new, :edit, :destroy]\nend\n",
    "web/routes.php": "<?php\nuse Illuminate\\Support\\Facades\\Route;\nRoute::resource('photos', PhotoController::class);\n",
    "nest/app.module.ts": "import { RouterModule, Module } from '@nestjs/core';\n@Module({\n  imports: [RouterModule.register([{ path: 'adm', module: AdminModule }])],\n})\nexport class AppModule {}\n",
    "nest/admin.module.ts": "@Module({\n  controllers: [UsersController],\n})\nexport class AdminModule {}\n",
    "nest/users.controller.ts": "@Controller('users')\nexport class UsersController {\n  @Get(':id')\n  one() {\n    return 1;\n  }\n}\n",
    "go/main.go": "package main\n\nimport \"github.com/gin-gonic/gin\"\n\nfunc one(r *gin.Engine) {\n\tv1 := r.Group(\"/v1\")\n\tadmin := v1.Group(\"/admin\")\n"
                  "\tadmin.GET(\"/stats\", stats)\n\tr.GET(\"/ping\", ping)\n}\n\nfunc two(r *gin.Engine) {\n\tv1 := r.Group(\"/two\")\n\tv1.GET(\"/b\", b)\n}\n",
}


def test_mounted_routes(spark):
    g = build(sources.frame(spark, PROJECT)).materialised()
    got = {(r["file_path"], r["name"]) for r in g.nodes.filter("kind = 'route'").collect()}
    assert got == {
        ("server/app.js", "GET /health"), ("server/routes/users.js", "GET /api/users"), ("server/routes/deep.js", "POST /api/deep/x"),
        ("server/routes/items.js", "GET /v2/items"), ("fast/main.py", "GET /root"), ("fast/routers/users.py", "GET /u/own/me"),
        ("fast/admin.py", "POST /admin/ban"), ("dj/urls.py", "ANY /home/"), ("dj/shop/urls.py", "ANY /shop/cart/"),
        ("dj/urls.py", "ANY /shop/"), ("fl/web.py", "POST /save"), ("fl/web.py", "ANY /todos"),
        ("config/routes.rb", "GET /posts"), ("config/routes.rb", "GET /posts/:id"), ("config/routes.rb", "POST /entry"),
        ("config/routes.rb", "GET /entry/:id"), ("config/routes.rb", "PATCH /entry/:id"), ("web/routes.php", "resource:photos"),
        ("nest/users.controller.ts", "GET /adm/users/:id"),
        ("go/main.go", "GET /v1/admin/stats"), ("go/main.go", "GET /ping"), ("go/main.go", "GET /two/b")}
    n = g.nodes.select("id", "name")
    led = g.edges.filter("kind = 'imports'").join(n.toDF("source", "s"), "source").join(n.toDF("target", "t"), "target")
    assert led.filter("s = 'ANY /shop/'").select("t").collect()[0]["t"] == "urls.py"


def test_nested_ignore_rules(spark, tmp_path):
    texts = {".gitignore": "*.gen.ts\n/only\nlogs/\n# note\n\n!back.gen.ts\na/**/z.ts\n[!k]x.ts\n\\!odd.ts", "p/.gitignore": "!one.gen.ts\n/here.ts\nsub/deep.ts\n",
             "p/logs/.gitignore": "!kept.ts", "q/.gitignore": None}
    want = {"a.gen.ts": True, "back.gen.ts": False, "p/one.gen.ts": False, "p/q/one.gen.ts": False, "q/one.gen.ts": True, "only": True, "p/only": False,
            "p/here.ts": True, "p/w/here.ts": False, "p/sub/deep.ts": True, "p/logs/kept.ts": True, "logs": False, "a/z.ts": True, "a/b/c/z.ts": True,
            "b/z.ts": False, "kx.ts": False, "jx.ts": True, "!odd.ts": True, "axgen.ts": False}
    rules = ignores.rules(spark.createDataFrame(list(texts.items()), "path string, content string"))
    paths = spark.createDataFrame([(p, 1) for p in want] + [(None, 2)], "path string, n int")
    got = {r["path"]: r["ignored"] for r in ignores.ignored(paths, rules).collect()}
    assert got == {**want, None: False}
    assert ignores.ignored(paths, rules.limit(0)).filter("ignored").count() == 0
    for path, text in {"a/x.ts": "1", "a/y.ts": "1", "a/.gitignore": "x.ts\n", "b/x.ts": "1"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    assert {r["path"] for r in S.scan(spark, str(tmp_path)).collect()} == {"a/y.ts", "b/x.ts"}
    assert {r["path"] for r in S.read_contents(spark, str(tmp_path)).collect()} == {"a/y.ts", "b/x.ts"}
